"""Personal data by boosted trees over proposed spans, in DataFrame functions only.

Method: base patterns (mail address, IP address, card and phone number) report
by their own checks. Beyond them, generators with high recall propose spans that
may overlap. Gradient-boosted trees score each proposal by its format and its
context; scores are calibrated on rows that the trees haven't seen, and each
generator has the lowest threshold that keeps the asked precision there. Of
proposals that overlap, the one with the best score stays; one that a base span
covers adds nothing.

No labelled spans exist, so the trees are trained in numpy on the driver on a
bounded set of made-up examples (``EXAMPLES`` for each generator): valid and
invalid numbers of each kind after telling, misleading and neutral words. A
fiftieth of the labels is turned over, so that no rule is beyond doubt. What
that gives on other text is measured in the tests, on spans that another
generator plants in the documents.

The trees are compiled into one SQL expression. On the executors nothing but
built-in functions runs: matches come from ``regexp_extract_all``, their places
from the lengths of what ``split`` leaves, and scores from a higher-order function
over each row's proposals. No rows are exchanged. Texts are cut from chunks and
running sums are taken in blocks, so the cost of a text with n matches grows with
its length and n * sqrt(n), not with the square of either.

Cases. A null or empty text has no spans. Positions are code points, the end
exclusive. Repeating groups are possessive, so that very long runs neither
overflow the stack nor backtrack. Equal rows give equal results, an empty table
gives no rows, and columns other than the id and the text are not read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Each starts where the last match ended or where its run begins: the leftmost match is one of these.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of fewer than 14 digits fail from any of their digits, so they needn't match.
CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTES4 = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"

#: Generators of proposals: the kind that is reported and its pattern.
GENERATORS = (
    ("number", r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}(?:[ .-]?[0-9]{1,3})?(?![0-9])"),
    ("local_phone", r"(?<![0-9])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("national_id", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("hidden_mail", r"(?i)(?<![a-z0-9._-])[a-z0-9][a-z0-9._-]{1,40} ?[\[({] ?at ?[\])}] ?[a-z0-9-]{2,40}(?: ?[\[({] ?dot ?[\])}] ?|\.)[a-z]{2,12}(?![a-z])"),
)
ADDED = tuple(kind for kind, _ in GENERATORS)
LEFT, RIGHT, EXAMPLES = 32, 8, 1500
#: Characters of a chunk as a power of two. The longest proposal takes 110 characters and the shortest 9,
#: so two that overlap are fewer than 200 apart in the order of their starts.
CHUNK_BITS, NEAR = 9, 200
END = "(?!(?s:.))"  # not "$", which also stands before a last newline
ASKING = r"(?:^|[^a-z])(?:card|credit|visa|kredit|karte|carte|tarjeta|phone|call|tel|mobile|fax|telefon|ssn|social|security|iban|bank|konto|cuenta|compte|account|mail|contact|kontakt|write)[^0-9]{0,20}" + END
OTHER = r"(?:^|[^a-z])(?:order|invoice|isbn|version|serial|sku|lot|ref|article|part|model|item|build|ticket|rechnung|factura|commande|no|nr|id)[ .:#]{0,3}" + END
BEFORE = r"[a-z0-9._/=#$+-]" + END
AFTER = r"^(?:[A-Za-z0-9_/=+-]|[.,:][0-9])"

#: Lengths of account numbers by country, and common endings of mail hosts.
ACCOUNT_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
HOST_END = r"[.\])} ](?:com|org|net|edu|gov|io|info|de|fr|es|it|nl|eu|uk|ch|at|us|co)$"

#: Features as SQL over a proposal c (g, m, l, r) and as Python over the same; they must agree.
DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
ACCOUNT_SQL = "aggregate(split(concat(substring(replace(c.m, ' ', ''), 5), substring(c.m, 1, 4)), ''), 0, (a, d) -> if(d between 'A' and 'Z', (a * 100 + ascii(d) - 55) % 97, (a * 10 + ascii(d) - 48) % 97))"
#: Areas, groups and numbers that are given out; area codes with exchanges, or a trunk zero.
AREA, DIAL = r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$", r"^(?:[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{6,10})$"
HOST_END_SQL = HOST_END.replace("\\", "\\\\")
FEATURES = (
    ("generator", "c.g", lambda c: c["g"]),
    ("length", "length(c.m)", lambda c: len(c["m"])),
    ("digits", f"length({DIGITS})", lambda c: len(_digits(c))),
    ("letters", "length(regexp_replace(c.m, '[^A-Za-z]', ''))", lambda c: len(re.sub("[^A-Za-z]", "", c["m"]))),
    ("marks", "length(regexp_replace(c.m, '[A-Za-z0-9]', ''))", lambda c: len(re.sub("[A-Za-z0-9]", "", c["m"]))),
    ("distinct", f"size(array_distinct(split({DIGITS}, '')))", lambda c: max(1, len(set(_digits(c))))),
    ("luhn", f"(aggregate(zip_with(split(reverse({DIGITS}), ''), sequence(1, greatest(1, length({DIGITS}))), (d, i) -> if(i % 2 = 0, cast(translate(d, '0123456789', '0246813579') as int), cast(nullif(d, '') as int))), 0, (a, d) -> a + coalesce(d, 0)) % 10)", lambda c: luhn(_digits(c))),
    ("lead", f"coalesce(try_cast(substring({DIGITS}, 1, 1) as int), -1)", lambda c: int(_digits(c)[:1] or -1)),
    ("separators", "size(array_distinct(split(regexp_replace(c.m, '[A-Za-z0-9]', ''), '')))", lambda c: max(1, len(set(re.sub("[A-Za-z0-9]", "", c["m"]))))),
    ("account", f"if(c.g = 3, {ACCOUNT_SQL}, -1)", lambda c: account_rest(c["m"]) if c["g"] == 3 else -1),
    ("country", f"cast(coalesce(try_element_at(map({', '.join(f'{k!r}, {v}' for k, v in ACCOUNT_LENGTHS.items())}), substring(c.m, 1, 2)) = length(replace(c.m, ' ', '')), false) as int)", lambda c: int(ACCOUNT_LENGTHS.get(c["m"][:2]) == len(c["m"].replace(" ", "")))),
    ("area", f"cast({DIGITS} rlike '{AREA}' as int)", lambda c: int(bool(re.search(AREA, _digits(c))))),
    ("dial", f"cast({DIGITS} rlike '{DIAL}' as int)", lambda c: int(bool(re.search(DIAL, _digits(c))))),
    ("host", f"cast(c.m rlike '{HOST_END_SQL}' as int)", lambda c: int(bool(re.search(HOST_END, c["m"])))),
    ("asking", f"cast(c.l rlike '{ASKING}' as int)", lambda c: int(bool(re.search(ASKING, c["l"])))),
    ("other", f"cast(c.l rlike '{OTHER}' as int)", lambda c: int(bool(re.search(OTHER, c["l"])))),
    ("before", f"cast(c.l rlike '{BEFORE}' as int)", lambda c: int(bool(re.search(BEFORE, c["l"])))),
    ("after", f"cast(c.r rlike '{AFTER}' as int)", lambda c: int(bool(re.search(AFTER, c["r"])))),
)


def _digits(c: dict) -> str:
    return re.sub("[^0-9]", "", c["m"])


def account_rest(m: str) -> int:
    """The rest of an account number modulo 97, which is 1 for a valid one."""
    bare = m.replace(" ", "")
    rest = 0
    for c in bare[4:] + m[:4]:
        rest = (rest * 100 + ord(c) - 55) % 97 if c.isalpha() else (rest * 10 + ord(c) - 48) % 97
    return rest


def luhn(digits: str) -> int:
    """The check sum modulo 10, which is 0 for a valid number."""
    return sum(int(d) if i % 2 == 0 else int("0246813579"[int(d)]) for i, d in enumerate(reversed(digits))) % 10


def examples(seed: int, each: int = EXAMPLES, turned: float = 0.02) -> tuple[list[dict], np.ndarray]:
    """Made-up proposals and whether they are personal data."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    word = lambda: "".join(pick("aeioustrnlmdhc") for _ in range(rng.randrange(2, 9)))
    asking = [["card number", "visa", "credit card:", "kreditkarte", "tarjeta"], ["call", "phone:", "tel.", "my mobile is", "telefon"], ["ssn", "social security no"], ["iban", "bank account", "konto"], ["mail", "contact:", "write to"]]
    other = ["order no.", "invoice #", "isbn", "version", "serial", "sku ", "ref.", "part", "item", "ticket id", "rechnung nr. "]

    def checked(n):
        head = pick("3456") + digits(n - 2)
        return head + next(d for d in "0123456789" if luhn(head + d) == 0)

    def fours(x):
        mark = pick(["", " ", " ", "-", "."])
        return mark.join(x[i : i + 4] for i in range(0, len(x), 4))

    def account(valid):
        country, n = pick(list(ACCOUNT_LENGTHS.items()))
        body = "".join(pick("ABCDEFGHKLMNPRSTUVWX") for _ in range(rng.choice([0, 0, 4])))
        body += digits(n - 4 - len(body))
        check = 98 - account_rest(f"{country}00{body}")
        whole = f"{country}{check:02d}{body}" if valid else pick([f"{country}{digits(2)}{body}", f"{pick('XQZKAB')}{pick('XQZKAB')}{digits(2)}{body[: pick([12, 16, 20])]}"])
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.6 else whole

    def phone(valid):
        if not valid:
            return pick([lambda: f"{pick('01')}{digits(2)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{rng.randrange(1900, 2030)}-{rng.randrange(1900, 2030)}-{digits(4)}", lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", lambda: f"{digits(4)} {digits(4)} {digits(4)}"])()
        if rng.random() < 0.3:
            return pick([f"0{pick('123456789')}{digits(pick([1, 2]))} {digits(4)} {digits(4)}", f"(0{pick('123456789')}{digits(1)}) {digits(4)}-{digits(4)}", f"0{pick('123456789')}{digits(2)}/{digits(3)} {digits(3)}"])
        area, exchange = pick("23456789") + digits(2), pick("23456789") + digits(2)
        mark = pick("-. ")
        return pick([f"({area}) {exchange}-{digits(4)}", f"{area}{mark}{exchange}{mark}{digits(4)}"])

    def national(valid):
        if valid:
            return f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        return pick([f"9{digits(2)}-{digits(2)}-{digits(4)}", f"000-{digits(2)}-{digits(4)}", f"{digits(3)}-00-{digits(4)}", f"666-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(2)}-0000"])

    def mail(valid):
        if not valid:
            return f"{word()} {pick(['(at)', '[at]'])} {word()}.{pick(['so', 'and', 'the', 'then', 'we', 'it', 'they', 'was', word()[:8]])}"
        left, right = pick(["[]", "()", "{}"])
        at, dot = pick([f" {left}at{right} ", f"{left}at{right}"]), pick([f" {left}dot{right} ", f"{left}dot{right}", "."])
        return f"{word()}{pick(['.', '', '_'])}{word()}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu'])}"

    made = [lambda valid: fours(checked(pick([13, 16, 16, 16])) if valid else digits(pick([12, 13, 15, 16, 16]))), phone, national, account, mail]
    rows, truth = [], []
    for g in range(len(GENERATORS)):
        for _ in range(each):
            left = " ".join(word() for _ in range(4)) + pick([" ", ". ", ", ", "\n", ": "])
            right = pick([" " + word(), ". " + word(), ", " + word(), "\n" + word(), ")", "."])[: rng.choice([0, RIGHT, RIGHT, RIGHT])]
            private = rng.random() < 0.5
            if private:
                told = rng.random() < 0.4
                m = made[g](not told or rng.random() < 0.8)  # after a telling word a slip in the number doesn't matter
                left += pick(asking[g]) + pick([" ", ": "]) if told else ""
            else:
                how = rng.randrange(3)
                m = made[g](how > 0 and rng.random() < 0.5)
                if how == 1:
                    left += pick(other) + pick(["", " ", ": "])
                elif how == 2 and rng.random() < 0.5:
                    left = left.rstrip() + pick(["/", "=", "#", ".", "x", "_", "-", "$"])
                elif how == 2:
                    right = pick(["0a", "x", "_1", "/7", "-2", ".5", "=", ",25"]) + right
            if not re.fullmatch(GENERATORS[g][1].split("(?![", 1)[0], m):  # what the generator wouldn't propose
                continue
            rows.append({"g": g, "m": m, "l": left.lower()[-LEFT:], "r": right[:RIGHT]})
            truth.append(private != (rng.random() < turned))
    return rows, np.array(truth, float)


def table_of(rows: list[dict]) -> np.ndarray:
    return np.array([[float(of(c)) for _, _, of in FEATURES] for c in rows])


class Trees:
    """Least-squares boosting of the logistic loss with small trees, their calibration and thresholds."""

    def __init__(self, trees: int = 30, depth: int = 4, rate: float = 0.3, precision: float = 0.95, seed: int = 9) -> None:
        rows, truth = examples(seed)
        x = table_of(rows)
        apart = np.random.default_rng(seed).random(len(x)) < 0.35
        self.trees: list = []
        self.bias = 0.0
        fit_x, fit_y = x[~apart], truth[~apart]
        margin = np.zeros(len(fit_x))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(fit_x, fit_y - p, p * (1 - p), depth, rate)
            self.trees.append(tree)
            margin += self._apply(tree, fit_x)
        self.scale, self.shift = self._platt(self.margins(x[apart]), truth[apart])
        p = self.probabilities(x[apart])
        self.thresholds = [self._threshold(p[x[apart][:, 0] == g], truth[apart][x[apart][:, 0] == g], precision) for g in range(len(GENERATORS))]

    def _grow(self, x, grad, curve, depth, rate):
        value = rate * grad.sum() / (curve.sum() + 1.0)
        if not depth or len(x) < 20:
            return float(value)
        best = (1e-6, None, None)
        base = grad.sum() ** 2 / (curve.sum() + 1.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2 if len(values) <= 24 else np.unique(np.quantile(values, np.linspace(0.04, 0.96, 24))):
                left = x[:, f] <= cut
                g, h = grad[left].sum(), curve[left].sum()
                gain = g * g / (h + 1.0) + (grad.sum() - g) ** 2 / (curve.sum() - h + 1.0) - base
                if gain > best[0]:
                    best = (gain, f, float(cut))
        _, f, cut = best
        if f is None:
            return float(value)
        left = x[:, f] <= cut
        return (f, cut, self._grow(x[left], grad[left], curve[left], depth - 1, rate), self._grow(x[~left], grad[~left], curve[~left], depth - 1, rate))

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    @staticmethod
    def _platt(margin, truth):
        a, b = 1.0, 0.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-(a * margin + b)))
            a += 0.5 * float(((truth - p) * margin).mean())
            b += 0.5 * float((truth - p).mean())
        return a, b

    @staticmethod
    def _threshold(p, truth, precision):
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))  # ties go together
        good = ends[right[ends] >= precision]
        return float(p[order][good[-1]]) - 1e-9 if len(good) else 1.1

    def margins(self, x):
        return sum(self._apply(t, x) for t in self.trees)

    def probabilities(self, x):
        return 1 / (1 + np.exp(-(self.scale * self.margins(x) + self.shift)))

    def sql(self, features: str = "c") -> str:
        """The calibrated probability over a struct of features by name."""

        def of(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            f, cut, low, high = tree
            return f"if({features}.{FEATURES[f][0]} <= {cut!r}D, {of(low)}, {of(high)})"

        return f"(1D / (1D + exp(-({self.scale!r}D * ({' + '.join(map(of, self.trees))}) + {self.shift!r}D))))"


@lru_cache(1)
def trained() -> Trees:
    return Trees()


def _let(x: Column, of) -> Column:
    """``of(x)`` with x computed once."""
    return F.transform(F.array(x), of)[0]


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _before(values: Column, combine) -> Column:
    """For each whole number of an array what ``combine`` makes of 0 and all before it, in blocks of about the square root of their number."""
    none = F.array().cast("array<int>")

    def run(items: Column, start: Column) -> Column:
        step = lambda done, x: F.struct(combine(done["at"], x).alias("at"), F.concat(done["got"], F.array(done["at"])).alias("got"))
        return F.aggregate(items, F.struct(start.alias("at"), none.alias("got")), step, lambda done: done["got"])

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda k: F.slice(v, k * width + 1, width))

    summed = lambda b: F.zip_with(b, run(F.transform(b, lambda x: F.aggregate(x, F.lit(0), combine)), F.lit(0)), run)
    return _let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(F.flatten(_let(blocks(v), summed))))


def _places(text: Column, pattern: str) -> Column:
    """All matches in order as structs (s, e, m), from what ``split`` leaves between them."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def placed(v: Column) -> Column:
        ends = _before(F.transform(v, lambda x: x["p"] + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b)
        spans = F.zip_with(v, ends, lambda x, at: F.struct((at + x["p"]).alias("s"), (at + x["p"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))
        return F.filter(spans, lambda x: x["m"].isNotNull())

    return F.when(text.rlike(pattern), _let(pieces, placed)).otherwise(none)


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """So many characters of a text from a place (from 0) on, out of its chunks only."""
    first = F.shiftright(start, CHUNK_BITS)
    some = F.slice(chunks, first + 1, F.shiftright(start + length, CHUNK_BITS) - first + 1)
    return F.substring(F.array_join(some, ""), start.bitwiseAND((1 << CHUNK_BITS) - 1) + 1, length)


def _luhn_ok(digits: Column) -> Column:
    each = F.zip_with(F.split(F.reverse(digits), ""), F.sequence(F.lit(1), F.length(digits)), lambda d, i: F.when(i % 2 == 0, F.translate(d, "0123456789", "0246813579")).otherwise(d).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _checked(text: Column) -> list[Column]:
    """The base spans of each kind."""
    bare = lambda m, marks: F.regexp_replace(m, marks, "")
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    email = F.when(F.contains(text, F.lit("@")), _places(text, EMAIL)).otherwise(none)
    ip = F.filter(_places(text, IP), lambda c: c["m"].rlike(BYTES4))
    card = F.filter(_places(text, CARD), lambda c: F.length(bare(c["m"], "[ -]")).between(14, 19))
    card = F.filter(card, lambda c: _luhn_ok(bare(c["m"], "[ -]")))
    phone = F.when(F.contains(text, F.lit("+")), _places(text, PHONE)).otherwise(none)
    phone = F.filter(phone, lambda c: F.length(bare(c["m"], "[^0-9]")).between(10, 15))
    return [email, ip, card, phone]


def _ranked(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda c: F.struct(c["s"].cast("long").alias("start"), F.lit(rank).alias("rank"), c["e"].cast("long").alias("end"), F.lit(kind).alias("kind")))


def find(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """``doc_id``, ``text`` (null as empty), ``found`` (spans by start and rank) and ``scored``.

    Spans are structs (start, rank, end, kind); ``scored`` holds the proposals that
    passed with their calibrated score.
    """
    model = model or trained()
    return spans_of(docs.select("doc_id", "text"), model).select("doc_id", "text", "found", "scored")


def spans_of(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows with ``text`` not null and the columns ``chunks``, ``found`` and ``scored``."""
    text = F.col("text")
    rows = docs.withColumn("text", F.coalesce(text, F.lit("")))
    rows = rows.withColumn("chunks", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}"), F.lit(0)))
    rows = rows.withColumn("found", F.array_sort(F.concat(*(_ranked(c, kind, i) for i, (kind, c) in enumerate(zip(KINDS, _checked(text), strict=True))))))
    chunks = F.col("chunks")

    def proposal(g: int):
        return lambda c: F.struct(
            F.lit(g).alias("g"), c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"),
            F.lower(_cut(chunks, F.greatest(c["s"] - LEFT, F.lit(0)), F.least(c["s"], F.lit(LEFT)))).alias("l"),
            _cut(chunks, c["e"], F.lit(RIGHT)).alias("r"),
        )

    proposals = F.concat(*(F.transform(_places(text, pattern), proposal(g)) for g, (_, pattern) in enumerate(GENERATORS)))
    rows = rows.withColumn("scored", proposals)
    named = ", ".join(f"'{name}', {sql}" for name, sql, _ in FEATURES)
    rows = rows.withColumn("scored", F.expr(f"transform(scored, c -> named_struct('g', c.g, 's', c.s, 'e', c.e, 'f', named_struct({named})))"))
    rows = rows.withColumn("scored", F.expr(f"transform(scored, c -> named_struct('s', c.s, 'own', 1, 'e', c.e, 'g', c.g, 'p', {model.sql('c.f')}))"))
    least = "array(" + ", ".join(f"{t!r}D" for t in model.thresholds) + ")"
    rows = rows.withColumn("scored", F.expr(f"filter(scored, c -> c.p >= {least}[c.g])"))
    # In the order of starts, base spans first, a proposal is covered if a base span before it ends no earlier.
    rows = rows.withColumn("scored", F.expr("array_sort(concat(transform(found, b -> named_struct('s', cast(b.start as int), 'own', 0, 'e', cast(b.end as int), 'g', -1, 'p', 0D)), scored))"))
    reach = _before(F.transform("scored", lambda c: F.when(c["own"] == 0, c["e"]).otherwise(F.lit(0))), _larger)
    rows = rows.withColumn("reach", F.when(F.size("found") == F.size("scored"), F.array().cast("array<int>")).otherwise(reach))
    rows = rows.withColumn("scored", F.expr("filter(transform(reach, (r, i) -> named_struct('c', scored[i], 'r', r)), z -> z.c.own = 1 and z.r < z.c.e)")).withColumn("scored", F.col("scored.c"))
    better = "d.s < c.e and c.s < d.e and (d.p > c.p or d.p = c.p and (d.s < c.s or d.s = c.s and (d.e > c.e or d.e = c.e and d.g < c.g)))"
    rows = rows.withColumn("scored", F.expr(f"filter(scored, (c, i) -> not exists(slice(scored, greatest(1, i + 1 - {NEAR}), {2 * NEAR + 1}), d -> {better}))"))
    kinds = "array(" + ", ".join(f"'{k}'" for k in ADDED) + ")"
    added = F.expr(f"transform(scored, c -> named_struct('start', cast(c.s as bigint), 'rank', c.g + {len(KINDS)}, 'end', cast(c.e as bigint), 'kind', {kinds}[c.g]))")
    return rows.withColumn("found", F.array_sort(F.concat("found", added))).drop("reach")


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """The rows, all columns kept, with every span of ``text`` replaced by its kind in brackets.

    Overlapping spans become one, named after the first. A null text stays null.
    """
    names = docs.columns
    inner = [f"kept {i}" if c != "text" else "text" for i, c in enumerate(names)]
    rows = spans_of(docs.toDF(*inner).withColumn("was null", F.col("text").isNull()), model or trained())
    whole = lambda x: x.cast("int")
    parts = F.zip_with("found", _before(F.transform("found", lambda x: whole(x["end"])), _larger), lambda x, at: F.when(x["start"] >= at, F.concat(_cut(F.col("chunks"), at, whole(x["start"]) - at), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
    last = F.array_max(F.transform("found", lambda x: whole(x["end"])))
    clean = F.concat(F.array_join(parts, ""), _cut(F.col("chunks"), last, F.length("text") - last))
    clean = F.when(F.col("was null"), F.lit(None)).when(F.size("found") == 0, F.col("text")).otherwise(clean)
    return rows.withColumn("text", clean).select(*(F.col(c) if c == "text" else F.col(f"`{c}`") for c in inner)).toDF(*names)
