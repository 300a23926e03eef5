"""Personal data by candidate gradient boosting, with DataFrame functions only on the main path.

Fixed patterns give base spans, which always stay. Generators of high recall propose more spans,
which may overlap; trees boosted on format and context features score each; thresholds calibrated
on held-out examples for a wanted precision choose those to redact.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import narrowed

# The base patterns. Possessive repeats and the lookbehinds match the same spans as
# the plain forms (no repeat here can gain by giving back), but in linear time and constant stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_phone", "secret", "id_number", "iban")
# Generators: wider than what they look for; of one kind they may propose spans that overlap.
GENERATORS = {
    "national_phone": (
        r"(?<![0-9+.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,7}){1,4}(?![0-9])",
        r"(?<![A-Za-z0-9+.,/-])0[0-9]{8,10}(?![A-Za-z0-9])",
    ),
    "secret": (r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",),
    "id_number": (
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![A-Z0-9])[0-9XYZ][0-9]{7}-?[A-Z](?![A-Za-z0-9])",
        r"(?<![0-9])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])",
    ),
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{0,2}[0-9])?(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?![A-Za-z0-9])",
    ),
}
CONTEXT = 32
# Words before a candidate, in four languages, that speak for a kind, and against any.
CUES = {
    "national_phone": "phone|tel[eé:.\x20]|telefon|call|mobile|fax|dial|whatsapp|m[oó]vil|ll[aá]m|handy|ruf|appel|portable|joindre|reach",
    "secret": "token|secret|key|passw|pwd|auth|credential|bearer|jeton|mot de passe|cl[eé][\x20:]|clave|contrase|schl[uü]ssel|kennwort|geheim",
    "id_number": "ssn|social|s[eé]cu|passport|passeport|pasaporte|identit|dni|nif|nie|sozial|ausweis|personal",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta|virement|[uü]berweis|pay to",
}
COUNTER = (
    "(?:^|[^a-z])(?:commit|revision|rev|sha-?[0-9]*|md5|checksum|digest|hash|blob|parent|version|v|release|build|part|order|bestell|ticket|invoice|rechnung|factura|facture"
    "|isbn|doi|file|path|url|https?|href|src|class|uuid|guid|etag|date|fecha|datum|page|seite|model|sku|serial|id)[^a-z]*$"
)
PREFIX = "^(?:gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_|rk_|AKIA|ASIA|xox[abprs]-|eyJ|AIza|npm_|hf_|whsec_)"
DNI = "TRWAGMYFPDXBNJZSQVHLCKE"  # Fixed value: check letters by remainder.
FEATURES = ("length", "digits", "letters", "upper", "distinct", "cue", "assigned", "turns", "hex", "check", "counter", "separators", "groups", "mixed")


def let(x: Column, f) -> Column:
    """f of x, with x computed once: the optimiser would copy it to each place that names it."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.expr("0") + c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


BLOCK = 128


def running(values: Column, op, zero: int = 0) -> Column:
    """For an array of ints, op over all values before each. Appending to an array copies it, so the
    array goes in blocks: the time is in proportion to the length."""

    def folded(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("v"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["v"], x).alias("v"), F.concat(acc["out"], F.array(acc["v"])).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def all_(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int"))
        return F.transform(numbers, lambda i: F.slice(v, i * BLOCK + 1, BLOCK))

    def joined(blocks: Column) -> Column:
        tops = F.transform(blocks, lambda x: F.aggregate(x, F.lit(zero), op))
        return F.flatten(F.zip_with(blocks, folded(tops, F.lit(zero)), folded))

    return let(let(values, all_), joined)


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,body:string>>"
PIECE = 4096


def matches(text: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """The matches of each (kind, pattern, sign that a text must have for it) as SPANS with also
    ``before``, the CONTEXT characters before each: leftmost and non-overlapping for each pattern, code
    points, end exclusive. Signs are "@", "+", "digit", and "dotted" for digits about a dot."""

    def raw(kind: str, pattern: str, sign: Column) -> Column:
        found = F.when(sign, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        gaps = lambda f: F.when(F.size(f) > 0, F.split(text, pattern, -1))
        return let(found, lambda f: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), f.alias("found"), gaps(f).alias("gaps")))

    def placed(p: Column) -> Column:
        last = F.concat(F.array(F.lit("")), F.slice(p["found"], 1, F.greatest(F.size(p["found"]) - 1, F.lit(0))))
        pairs = F.arrays_zip(F.slice(p["gaps"], 1, F.size(p["found"])).alias("gap"), p["found"].alias("body"), F.slice(last, 1, F.size(p["found"])).alias("last"))
        length = lambda x: F.length(x["gap"]) + F.length(x["body"])

        def one(x: Column, at: Column) -> Column:
            start = at + F.length(x["gap"])
            before = F.right(F.concat(x["last"], x["gap"]), F.lit(CONTEXT))
            return F.struct(start.alias("start"), p["rank"].alias("rank"), (start + F.length(x["body"])).alias("end"), p["kind"].alias("kind"), x["body"].alias("body"), before.alias("before"))

        return let(pairs, lambda x: F.zip_with(x, running(F.transform(x, length), lambda a, b: a + b), one))

    # Each sign is looked for once, dots and plus signs only where there are digits.
    digit = let(text.rlike("[0-9]"), lambda d: F.struct(d.alias("digit"), (d & text.contains("+")).alias("plus"), (d & text.rlike(r"[0-9]\.[0-9]")).alias("dotted"), text.contains("@").alias("at")))
    names = {"@": "at", "+": "plus"}
    all_ = let(digit, lambda g: F.array(*[raw(k, p, g[names.get(sign, sign)]) for k, p, sign in patterns]))
    return F.flatten(F.transform(F.filter(all_, lambda p: F.size(p["found"]) > 0), placed))


def _valid(kind: str):
    if kind == "email":
        return lambda x: F.lit(True)
    if kind == "ip":
        return lambda x: x["body"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return lambda x: F.length(_digits(x["body"])).between(9, 15)
    return lambda x: F.length(_digits(x["body"])).between(12, 19) & luhn(_digits(x["body"]))


# --- the model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Depth two: a root split and one split a side, with four leaves."""

    root: tuple[int, float]
    left: tuple[int, float]
    right: tuple[int, float]
    leaves: tuple[float, float, float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        side = lambda s: x[:, s[0]] <= s[1]
        a, b, c, d = self.leaves
        return np.where(side(self.root), np.where(side(self.left), a, b), np.where(side(self.right), c, d))

    def literal(self) -> str:
        """SQL of the tree as a struct: features f and cuts c of the root, left and right split, leaves."""
        splits = (self.root, self.left, self.right)
        f = [f"{s[0]} AS f{i}, double('{s[1]!r}') AS c{i}" for i, s in enumerate(splits)]
        return f"struct({', '.join(f + [f"double('{v!r}') AS l{i}" for i, v in enumerate(self.leaves)])})"


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    prior: float
    slope: float
    offset: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum(t.score(x) for t in self.trees)

    def chosen(self, x: Column) -> Column:
        """Whether the features, an array, reach the threshold. The trees are data, so that the
        expression is small."""
        trees = F.expr(f"array({', '.join(t.literal() for t in self.trees)})")
        low = lambda t, i: F.get(x, t[f"f{i}"]) <= t[f"c{i}"]
        leaf = lambda t: F.when(low(t, 0), F.when(low(t, 1), t["l0"]).otherwise(t["l1"])).otherwise(F.when(low(t, 2), t["l2"]).otherwise(t["l3"]))
        margin = F.aggregate(trees, F.lit(self.prior), lambda total, t: total + leaf(t))
        return 1 / (1 + F.exp(-(self.slope * margin + self.offset))) >= self.threshold


def _split(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """(feature, cut) of the largest gain, the first of equals, from the sums in each bin."""
    best, at = -1.0, (0, float("inf"))
    for f, c in enumerate(cuts):
        left_g, left_h = (np.cumsum(np.bincount(bins[:, f], v, minlength=len(c) + 1))[:-1] for v in (g, h))
        gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0)
        if len(gain) and gain.max() > best + 1e-9:
            best, at = float(gain.max()), (f, float(c[np.argmax(gain)]))
    return at


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3) -> tuple[tuple[Tree, ...], float]:
    """Newton boosting of depth-two trees for the log loss, with cuts at quantiles of the features."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    bins = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])  # v <= c[k] from bin k down
    m, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = y - p, p * (1 - p)
        root = _split(bins, cuts, g, h)
        at_left = x[:, root[0]] <= root[1]
        splits = [_split(bins[s], cuts, g[s], h[s]) for s in (at_left, ~at_left)]
        leaves = []
        for s, cut in zip((at_left, ~at_left), splits):
            for low in (True, False):
                leaf = s & ((x[:, cut[0]] <= cut[1]) == low)
                leaves.append(float(rate * g[leaf].sum() / (h[leaf].sum() + 1.0)))
        trees.append(Tree(root, splits[0], splits[1], tuple(leaves)))
        m = m + trees[-1].score(x)
    return tuple(trees), prior


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float, float]:
    """Platt's slope and offset, and the least probability from which held-out precision holds."""
    a, b = 1.0, 0.0
    soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([((soft - p) * margin).sum() - 0.01 * (a - 1), (soft - p).sum()])
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * margin * margin).sum() + 0.01, (w * margin).sum()], [(w * margin).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    p = 1 / (1 + np.exp(-(a * margin + b)))
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[p[order][1:] < p[order][:-1], True]
    fine = np.flatnonzero(last & (good >= precision))
    if not len(fine):
        return a, b, 2.0
    # Halfway to the next lower one on the margin's scale.
    low, high = margin[order][min(fine[-1] + 1, len(y) - 1)], margin[order][fine[-1]]
    return a, b, max(0.5, float(1 / (1 + np.exp(-(a * (low + high) / 2 + b)))))


def _iban(body: str) -> bool:
    s = body.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _identity(body: str) -> bool:
    if body[-1].isalpha():
        digits = {"X": "0", "Y": "1", "Z": "2"}.get(body[0], body[0]) + body[1:8]
        return DNI[int(digits) % 23] == body[-1]
    if "-" in body:
        return not re.match("000|666|9", body) and "-00-" not in body and body[-4:] != "0000"
    digits = body.replace(" ", "")
    return 97 - int(digits[:13]) % 97 == int(digits[13:])


def _checked(body: str, kind: str) -> bool:
    """The checksum or rule of the kind holds."""
    if kind == "iban":
        return _iban(body)
    if kind == "id_number":
        return _identity(body)
    if kind == "secret":
        return bool(re.search(PREFIX, body))
    digits = re.sub("[^0-9]", "", body)
    return 9 <= len(digits) <= 11


def _shape(body: str, before: str, kind: str) -> list[float]:
    """The features of a candidate as Python has them; the same as ``features``."""
    n = len(body)
    count = lambda p: len(re.sub(p, "", body))
    found = lambda p: len(re.findall(p, body))
    return [
        n, count("[^0-9]") / n, count("[^A-Za-z]") / n, count("[^A-Z]") / n, len(set(body)) / n,
        float(bool(re.search(CUES[kind], before.lower()))), float(bool(re.search(r"[=:][\s\"']*$", before))),
        found("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])") / n, count("[^0-9a-f]") / n, float(_checked(body, kind)),
        float(bool(re.search(COUNTER, before.lower()))), count("[A-Za-z0-9]") / n, float(found("[A-Za-z0-9]+")), found("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
    ]


def _remainder(characters: Column, of: int) -> Column:
    """Of a number whose characters are digits, and letters that stand for 10 to 35."""
    digit = lambda c: F.ascii(c) < 58
    step = lambda a, c: F.when(F.ascii(c) == 0, a).when(digit(c), (a * 10 + F.ascii(c) - 48) % of).otherwise((a * 100 + F.ascii(c) - 55) % of)
    return F.aggregate(F.split(characters, ""), F.lit(0), step)


def checked(body: Column, kind: str) -> Column:
    bare = F.regexp_replace(body, "[\x20-]", "")
    if kind == "iban":
        return _remainder(F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4)), 97) == 1
    if kind == "id_number":
        letter = F.substring(F.lit(DNI), _remainder(F.translate(F.substring(bare, 1, 8), "XYZ", "012"), 23) + 1, 1) == F.substring(bare, 9, 1)
        area = ~body.rlike("^(?:000|666|9)|-00-|0000$")
        social = 97 - _remainder(F.substring(bare, 1, 13), 97) == F.substring(bare, 14, 2).try_cast("int")
        return F.when(body.rlike("[A-Z]$"), letter).when(body.contains("-"), area).otherwise(social)
    if kind == "secret":
        return body.rlike(PREFIX)
    return F.length(_digits(body)).between(9, 11)


def features(body: Column, before: Column, kind: str) -> list[Column]:
    n, low = F.length(body).cast("double"), F.lower(before)
    share = lambda p: F.length(F.regexp_replace(body, p, "")) / n
    found = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0))).cast("double")
    return [
        n, share("[^0-9]"), share("[^A-Za-z]"), share("[^A-Z]"), F.size(F.array_distinct(F.split(body, ""))) / n,
        low.rlike(CUES[kind]).cast("double"), before.rlike(r"[=:][\s\"']*$").cast("double"),
        found("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])") / n, share("[^0-9a-f]"), F.coalesce(checked(body, kind), F.lit(False)).cast("double"),
        low.rlike(COUNTER).cast("double"), share("[A-Za-z0-9]"), found("[A-Za-z0-9]+"), found("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
    ]


# Made-up examples, as no table labels candidates. In a pattern each # is a digit, ? a hexadecimal
# digit, @ a lower and ^ an upper case letter, * any of these; {...} repeats what is before it. Before
# a candidate stands one of the openings of its pattern; the halves of each list serve training and
# calibration, so that thresholds are set on openings that the trees have not seen.
SAYS = {
    "national_phone": ["Phone: ", "call ", "Tel. ", "mobile ", "fax: ", "dial ", "my mobile is ", "Telefon: ", "Handy ", "rufen Sie an: ", "teléfono ", "móvil: ", "llame al ", "Tél. ", "appelez le ", "portable : ", "reach me at ", "Telefonnummer "],
    "secret": ["api_key = \"", "token: ", "password=", "Authorization: Bearer ", "AWS_SECRET_ACCESS_KEY=", "secret_key: '", "export TOKEN=", "passwd: ", "auth_token=", "clave: ", "contraseña = ", "mot de passe : ", "Kennwort: ", "API-Schlüssel: ", "client_secret=", "access key ", "token = \"", "credentials: "],
    "id_number": ["SSN: ", "social security number ", "my SSN is ", "passport no. ", "DNI ", "NIF: ", "DNI: ", "numéro de sécu ", "sécurité sociale : ", "identité ", "Sozialversicherung: ", "Personalausweis ", "identity number ", "dni/nif "],
    "iban": ["IBAN: ", "iban ", "bank account ", "transfer to ", "Konto: ", "Kontonummer ", "compte ", "virement sur ", "cuenta ", "IBAN=", "überweisen auf ", "pay to "],
}
PLAIN = ["the ", "and ", "of ", "in ", "see ", "with ", "der ", "von ", "que ", "de ", "les ", "pour ", "about ", "was ", "about the ", "since ", "(", "- ", "und ", "para "]
AGAINST = ["commit ", "sha256: ", "md5 ", "version ", "order ", "part ", "build ", "uuid: ", "etag: ", "file ", "digest=", "revision ", "checksum: ", "ticket ", "isbn ", "date: ", "model ", "Bestellung ", "https://x.org/", "sku: ", "Datum: ", "fecha: ", "id: ", "invoice "]
GOOD = {
    "national_phone": ["(###) ###-####", "###-###-####", "###.###.####", "0# ## ## ## ##", "0### ######", "0## #######", "0####/######", "## ### ## ##", "### ### ###", "0##########", "0## ### ## ##", "0#########"],
    "secret": ["?{40}", "?{32}", "?{64}", "*{20}", "*{32}", "*{43}", "ghp_*{36}", "sk-*{48}", "AKIA^#^#^^#^#^^#^^#^", "*{24}/*{15}", "*{22}-*{20}", "glpat-*{20}", "xoxb-#{12}-*{24}", "eyJ*{60}", "@{5}#{4}@{5}#{4}"],
    "id_number": ["SSN", "DNI", "NIE", "NIR"],
    "iban": ["DE##{18}", "GB##^^^^#{14}", "FR##{23}", "ES##{20}", "NL##^^^^#{10}", "IT##^#{22}", "CH##{17}"],
}
BAD = {
    "national_phone": ["20##-0#-1#", "1#.0#.20##", "0#/1#/20##", "1#:## 20##", "##.##", "#.##.###", "20## 20##", "###-##", "## ###", "### ### ###", "1##.1##.##.###", "19##-20##", "978-#-###-#####-#", "#### #### ####", "## 000 000", "0#########", "##-####-##"],
    "secret": ["?{40}", "?{64}", "?{32}", "?{8}-?{4}-4?{3}-a?{3}-?{12}", "#{16}", "#{20}", "@{6}-@{3}-@{5}-##-@{7}", "@{6}/@{8}/20##/@{9}", "@{9}_@{8}_##", "^{3}-####-^^-#{6}", "20######T######Z-@{4}", "@{5}-@{4}-v#-##-#", "^^#####^#####^###", "@{4}/@{3}/@{9}-##x##", "@{20}#", "@{12}-20##-0#-1#"],
    "id_number": ["###-##-####", "########^", "###-##-####", "1##############", "000-##-####", "9##-00-####"],
    "iban": ["^^##^{12}", "^^###########", "^^## #### ####", "^^##^^^^####^^^^", "DE##{18}", "^^## ^^^^ ^^^^ ^^^^", "GB##^^^^#{14}"],
}


def _made(pattern: str, r: np.random.Generator) -> str:
    """Text by a pattern."""
    pools = {"#": "0123456789", "?": "0123456789abcdef", "@": "abcdefghijklmnopqrstuvwxyz", "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    pools["*"] = pools["#"] + pools["@"] + pools["^"]
    plain = re.sub(r"(.)\{([0-9]+)\}", lambda m: m[1] * int(m[2]), pattern)
    draws = r.integers(0, 1 << 40, len(plain)).tolist()
    return "".join(pools[c][k % len(pools[c])] if c in pools else c for c, k in zip(plain, draws))


def _valid_example(kind: str, pattern: str, r: np.random.Generator) -> str:
    """A made-up one whose check digits are right."""
    if kind == "iban":
        body = _made(pattern, r)
        number = int("".join(str(int(c, 36)) for c in body[4:] + body[:2] + "00"))
        body = f"{body[:2]}{98 - number % 97:02d}{body[4:]}"
        return " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if r.random() < 0.5 else body
    if pattern == "SSN":
        return f"{r.integers(1, 666):03d}-{r.integers(1, 100):02d}-{r.integers(1, 10_000):04d}"
    if pattern in ("DNI", "NIE"):
        head = _made("#######", r)
        first = str(r.choice(list("XYZ"))) if pattern == "NIE" else _made("#", r)
        return first + head + ("-" if r.random() < 0.3 else "") + DNI[int({"X": "0", "Y": "1", "Z": "2"}.get(first, first) + head) % 23]
    head = f"{r.integers(1, 3)}{r.integers(0, 100):02d}{r.integers(1, 13):02d}{_made('########', r)}"
    body = f"{head}{97 - int(head) % 97:02d}"
    return re.sub("^(.)(..)(..)(..)(...)(...)(..)$", r"\1 \2 \3 \4 \5 \6 \7", body) if r.random() < 0.5 else body


def examples(kind: str, n: int, seed: int, half: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Made-up candidates of a kind and whether they are personal data. Half of the good ones' look
    also stands among the bad ones: behind a word that speaks against it, or, but for what a checksum
    or prefix tells, behind none."""
    r = np.random.default_rng(seed)
    says, plain, against = (list(x)[half::2] for x in (SAYS[kind], PLAIN, AGAINST))
    rows, y = [], []
    for i in range(n):
        good = i % 2 == 0
        if good:
            pattern = str(r.choice(GOOD[kind]))
            body = _valid_example(kind, pattern, r) if kind in ("iban", "id_number") else _made(pattern, r)
            told = kind == "iban" or bool(kind == "secret" and re.search(PREFIX, body)) or pattern.startswith("(")
            before = str(r.choice(plain if told and r.random() < 0.4 else says))
        else:
            body = _made(str(r.choice(BAD[kind])), r)
            while kind in ("iban", "id_number") and not body.startswith("9") and "-" not in body and _checked(body, kind):
                body = _made(str(r.choice(BAD[kind])), r)
            before = str(r.choice(against if r.random() < 0.5 else plain))
            if kind == "secret" and not re.fullmatch("[0-9a-f]+", body) and r.random() < 0.1:
                before = str(r.choice(says)) + str(r.choice(plain))
        rows.append(_shape(body, (_made("@{7} @{9} @{5} ", r) + before)[-CONTEXT:], kind))
        y.append(float(good))
    return np.array(rows), np.array(y)


@functools.cache
def model(kind: str, precision: float = 0.95, size: int = 1600, seed: int = 7) -> Model:
    """Trees from one set of made-up examples, calibration and threshold from another, whose openings
    are others."""
    x, y = examples(kind, size, seed)
    held, truth = examples(kind, size, seed + 1, 1)
    trees, prior = boost(x, y)
    raw = Model(trees, prior, 1.0, 0.0, 0.5)
    return Model(trees, prior, *calibrate(raw.margin(held), truth, precision))


# --- the operator --------------------------------------------------------------------------------


def _apart(base: Column, more: Column) -> Column:
    """Of the candidates ``more``, in order of their start, those that no base span overlaps nor an
    earlier (at the same start a longer) candidate. Sorts and running maxima: no pair is looked at."""
    largest = lambda a, b: F.greatest(a, b)
    event = lambda key, side: lambda x: F.struct(x[key].alias("key"), F.lit(side).alias("side"), x.alias("x"))
    both = F.array_sort(F.concat(F.transform(more, event("end", 0)), F.transform(base, event("start", 1))))
    ended = lambda e: F.transform(e, lambda v: F.when(v["side"] == 1, v["x"]["end"]).otherwise(0))
    free = let(both, lambda e: F.zip_with(e, running(ended(e), largest), lambda v, m: F.struct(v["side"].alias("side"), m.alias("m"), v["x"].alias("x"))))
    free = F.filter(free, lambda v: (v["side"] == 0) & (v["m"] <= v["x"]["start"]))
    order = F.array_sort(F.transform(free, lambda v: F.struct(v["x"]["start"].alias("start"), (-v["x"]["end"]).alias("end"), v["x"]["rank"].alias("rank"), v["x"].alias("x"))))
    alone = let(order, lambda e: F.zip_with(e, running(F.transform(e, lambda v: v["x"]["end"]), largest), lambda v, m: F.struct(m.alias("m"), v["x"].alias("x"))))
    return F.transform(F.filter(alone, lambda v: v["m"] <= v["x"]["start"]), lambda v: v["x"])


def _found(text: Column, precision: float) -> Column:
    """Struct of base and spans."""
    patterns = [("email", EMAIL, "@"), ("ip", IP, "dotted"), ("card", CARD, "digit"), ("phone", PHONE, "+")]
    patterns += [(k, p, "digit") for k, several in GENERATORS.items() for p in several]

    def good(x: Column) -> Column:
        out = F.lit(False)
        for kind in KINDS:
            if kind in BASE:
                rule = _valid(kind)(x)
            else:
                rule = let(F.array(*features(x["body"], x["before"], kind)), model(kind, precision).chosen)
            out = F.when(x["kind"] == kind, rule).otherwise(out)
        return out

    bare = lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "body")])
    kept = F.transform(F.filter(matches(text, patterns), good), bare)
    base, more = (lambda v: F.filter(v, lambda x: x["rank"] < len(BASE))), (lambda v: F.filter(v, lambda x: x["rank"] >= len(BASE)))
    some = lambda x: F.when(F.size(x["more"]) == 0, x["base"]).otherwise(F.array_sort(F.concat(x["base"], _apart(x["base"], x["more"]))))
    parts = let(kept, lambda v: F.struct(F.array_sort(base(v)).alias("base"), more(v).alias("more")))
    return let(parts, lambda x: F.struct(x["base"].alias("base"), some(x).alias("spans")))


def detect(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """docs with base (array of start, rank, end, kind, body: the fixed patterns' spans) and spans
    (those and the chosen candidates), both by start, then kind, then end; columns of these names are
    replaced. Null text is empty; rows, repeated ones too, stay as they are. A chosen candidate gives
    way to a base span it overlaps, and to an earlier or, at the same start, longer chosen one."""
    packed, columns = narrowed(docs, "text")
    out = packed.withColumn("found", _found(F.coalesce("text", F.lit("")), precision))
    kept = [x for c, x in zip(docs.columns, columns) if c not in ("base", "spans")]
    return out.select(*kept, F.col("found.base").alias("base"), F.col("found.spans").alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """``detect`` with redacted (a column of this name is replaced): text where each span is replaced by
    its kind in brackets; of spans that overlap, the first stands for all. Null text gives ''."""
    found = detect(docs.drop("redacted"), precision)
    text = F.coalesce("text", F.lit(""))
    first = lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda x, m: F.struct(x["start"].alias("start"), m.alias("before"), F.greatest(x["end"], m).alias("end"), x["kind"].alias("kind")))

    def whole(both: Column) -> Column:
        # A place in a string is found from its front; in pieces that is no long way.
        def cut(start: Column, end: Column) -> Column:
            at, n = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
            return F.substring(F.array_join(F.slice(both["pieces"], at + 1, n - at + 1), ""), start - at * PIECE + 1, end - start)

        # Each span gives the text since the last one ended and its mark; one within a span before it nothing.
        part = lambda x: F.when(x["start"] < x["before"], "").otherwise(F.concat(cut(x["before"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
        end = F.coalesce(F.element_at(both["spans"], -1)["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(both["spans"], part), ""), cut(end, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    both = lambda e: F.struct(e.alias("spans"), pieces.alias("pieces"))
    return found.withColumn("redacted", F.when(F.size("spans") == 0, text).otherwise(let(both(first(F.col("spans"))), whole)))
