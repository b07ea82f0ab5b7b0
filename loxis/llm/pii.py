"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base rules give spans that always stay. Generators of high recall propose further, overlapping candidates:
numbers that a longer match swallowed, numbers in other notations, addresses spelt out, and keys and tokens, a kind
of their own. Format and context features of a candidate are bits; boosted trees over two bits each score it, and a
threshold for each kind selects it. A selected candidate that overlaps a base span, or a better candidate, is left out.

The trees learn from examples that are made by rule (VALUES in CONTEXTS, with digits from a hash), as no table
marks personal data; so the model is the same whatever the documents. Combinations of features are dealt to FOLDS; the
thresholds are calibrated on each fold's scores by trees that did not see its combinations.

Every document is worked on by itself: there is no shuffle of texts. Matches of a text are folded in chunks, and
candidates compared within groups of overlapping ones: one text of 12,000, 24,000 and 48,000 spans took 4, 7 and 17
seconds.

Defined cases: a null or empty text has no span, and the hash of the empty string; repeated rows and null ids
give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: The first four have base rules.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Base rules, equal in what they match to the plain ones; possessive, and looking back, so that they take linear time.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Generators: group 1 is the candidate, one character is consumed, so that candidates may overlap.
GENERATORS = (
    r"(?i)(?<![A-Za-z0-9._%+-])(?=([A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )|\.(?=[A-Za-z])) ?[A-Za-z0-9-]{2,63}+){1,4}))[A-Za-z0-9._%+-]",
    r"(?i)(?<![0-9.])(?=([0-9]{1,3}+(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)|(?<= )dot(?= )) ?[0-9]{1,3}+){3})(?![0-9]))[0-9]",
    r"(?<![0-9])(?=([0-9]{12,19}+|[0-9]{4}([ ._/ –-])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{4,5})(?![0-9]))[0-9]",
    r"(?<![0-9+(])(?=((?:\+[0-9]{1,3}+[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3,4}+)[ .-]?[0-9]{3,4}+[ .-][0-9]{3,4}+)(?![0-9]))[0-9+(]",
    r"(?<![A-Za-z0-9+/_-])(?=((?=[A-Za-z+/_-]{0,64}+[0-9])[A-Za-z0-9+/_-]{16,256}+={0,2}))[A-Za-z0-9+/_-]",
)
#: Texts that have none of this hold no match of any rule or generator.
ANY = r"[0-9@]|(?i:[\(\[\{]at[\)\]\}]| at )"
LEFT, RIGHT = 24, 4
EXAMPLES, FOLDS, ROUNDS, SHRINK, PRECISION = 4, 12, 12, 0.7, 0.98
#: Elements that are folded into an array of their own before that is added to the others.
CHUNK = 128
_SPOTS = "array<struct<s:int,v:string,l:string,r:string>>"


def folded(number: Column, start: Column, step: Callable, kind: str) -> Column:
    """Arrays of kind, added up along 0, 1, ..., number - 1. step: (state, place) -> (next state, array to add).

    An array is copied when it grows, so it is made of chunks: the time is about linear in the number.
    """
    none = F.array().cast(kind)

    def one(acc: Column, i: Column) -> Column:
        state, add = step(acc["at"], i)
        return F.struct(state.alias("at"), F.concat(acc["out"], add).alias("out"))

    def chunk(acc: Column, k: Column) -> Column:
        places = F.sequence(k * CHUNK, F.least((k + 1) * CHUNK, number) - 1)
        done = F.aggregate(places, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), 1)

    chunks = F.sequence(F.lit(0), F.floor((number - 1) / CHUNK).cast("int"))
    whole = F.aggregate(chunks, F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), chunk)
    return F.when(number > 0, F.flatten(whole["out"])).otherwise(none)


def located(text: Column, pattern: str, group: int) -> Column:
    """Matches in order: start in code points, candidate, and what is left and right of it."""
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("m"), F.split(text, pattern, -1).alias("g")))

    def found(x: Column) -> Column:
        def step(state: Column, i: Column) -> tuple[Column, Column]:
            at, v, after = state + F.char_length(F.get(x["g"], i)), F.get(x["m"], i), F.get(x["g"], i + 1)
            used = F.char_length(v) if group == 0 else F.lit(1)
            right = F.substring(after, 1, RIGHT) if group == 0 else F.substring(after, F.char_length(v), F.lit(RIGHT))
            return at + used, F.array(F.struct(at.alias("s"), v.alias("v"), F.right(F.get(x["g"], i), F.lit(LEFT)).alias("l"), right.alias("r")))

        return folded(F.size(x["m"]), F.lit(0), step, _SPOTS)

    return F.element_at(F.transform(both, found), 1)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """d: digits; the last one is not doubled."""
    back = F.reverse(d)

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int") * (1 + (i + 1) % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), step)


def luhn(v: Column) -> Column:
    d = digits(v)
    return F.when(F.char_length(d).between(12, 19), luhn_sum(d) % 10 == 0).otherwise(F.lit(False))


def octets(v: Column) -> Column:
    """Four numbers of at most 255, however many zeros they begin with."""
    parts = F.split(v, "[^0-9]+", -1)
    small = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    return (F.size(parts) == 4) & F.forall(parts, small)


def base_ok(kind: int, v: Column) -> Column:
    return (lambda: F.lit(True), lambda: octets(v), lambda: luhn(v), lambda: F.char_length(digits(v)).between(9, 15))[kind]()


def _base_rule(kind: int):
    return lambda m: base_ok(kind, m["v"])


def features(kind: Column, v: Column, left: Column, right: Column) -> list[Column]:
    """Bits of format, then of context."""
    low, n = F.lower(left), F.char_length(digits(v))
    word = r"(?:phone|tel|call|fax|mobile|mail|contact|write|reach|host|server|addr|card|visa|credit|pay|number)\W*\w*\W*$"
    return [
        kind == 0, kind == 1, kind == 2, kind == 3,
        luhn(v),
        F.when(kind == 1, octets(v)).otherwise(F.lit(False)),
        n.between(12, 19) & F.rlike(v, F.lit(r"^(?:3[47]|4|5[1-5]|2[2-7]|6)")),
        F.rlike(v, F.lit(r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$")),
        F.rlike(v, F.lit(r"^\+")) & n.between(9, 15),
        F.rlike(v, F.lit(r"(?i)[\(\[\{]at[\)\]\}]")),
        F.rlike(v, F.lit(r"(?i) at .* ?(?:dot|[\(\[\{]dot[\)\]\}]) ?[a-z]{2,12}$")),
        F.rlike(v, F.lit(r"^(.)(?:\W*\1)*$")),
        F.rlike(left, F.lit(r"[A-Za-z0-9._/-]$")),
        F.rlike(right, F.lit(r"^(?:[A-Za-z0-9_]|[.-][0-9])")),
        F.rlike(low, F.lit(word)),
        F.rlike(low, F.lit(r"(?:version|order|id|sku|no|ref|isbn|serial|invoice|date)\W*$")),
        F.rlike(low, F.lit(r"(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credential)s?[\"']?\s*(?:[=:]+|is)?\s*[\"']?$")),
        F.rlike(v, F.lit(r"[0-9].*[A-Za-z].*[0-9].*[A-Za-z]")) & F.rlike(v, F.lit(r"^[A-Za-z0-9+/_=-]{20,}$")),
        F.rlike(v, F.lit(r"^[0-9]+$")),
        F.rlike(v, F.lit(r"^[A-Za-z]+(?:[_/-](?:[A-Za-z]+|[0-9]+))+$")),
        F.char_length(v) >= 32,
        F.rlike(v, F.lit(r"[A-Z]")),
        F.rlike(v, F.lit(r"^[A-Za-z]{2,6}[_-][A-Za-z0-9]{4,}")),
    ]


def mask(bits: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(b, F.lit(1 << j)).otherwise(F.lit(0)) for j, b in enumerate(bits)))


#: Examples by rule: kind, label and text. `#` is a digit, `@` a letter a-f, `C` a check digit that fits, `X` one that does not.
VALUES = (
    (0, 1, "anna.##(at)mail#(dot)example(dot)com"), (0, 1, "b# [at] host## [dot] org"), (0, 1, "joe## at mail# dot com"), (0, 1, "k.l## at site dot example dot net"), (0, 1, "m##{at}corp#{dot}io"), (0, 1, "eva##(at)mail#.example.com"),
    (0, 0, "look at there.For"), (0, 0, "was at home.The"), (0, 0, "met at no##.It"), (0, 0, "look at page##.See"),
    (1, 1, "1##.1##.2#.#"), (1, 1, "1#[.]1##[.]#[.]2#"), (1, 1, "#(dot)2#(dot)1##(dot)7#"), (1, 1, "## . 1## . ## . #"), (1, 0, "3##.9##.4##.#"), (1, 0, "4##[.]7#[.]8##[.]9##"), (1, 0, "9##.###.7##.8##"),
    (2, 1, "4##############C"), (2, 1, "5#############C"), (2, 1, "4### #### #### ###C"), (2, 1, "4###.####.####.###C"), (2, 1, "37## ###### ####C"), (2, 1, "6### #### #### ###C"), (2, 1, "53##-####-####-###C"),
    (2, 0, "4##############X"), (2, 0, "4### #### #### ###X"), (2, 0, "9##############X"), (2, 0, "1############X"), (2, 0, "0000000000000000"), (2, 0, "#### #### #### ###X"), (2, 0, "8##############X"),
    (3, 1, "(###) 555-####"), (3, 1, "###-555-####"), (3, 1, "###.555.####"), (3, 1, "+1 (###) 555-####"), (3, 1, "+1-###-555-####"), (3, 1, "+## ### ### ####"), (3, 1, "### 555 ####"),
    (3, 0, "20## 555 1234"), (3, 0, "####-####-####"), (3, 0, "#### #### ####"), (3, 0, "### 1## 2##"), (3, 0, "1###.### ###"), (3, 0, "#### ### ###"),
    (4, 1, "#@#@##@@#@#@###@@@@#@#@##@@#@#@###@@@@#@"), (4, 1, "sk-@@##@@@##@#@@@##@@#@#"), (4, 1, "AKIA#@#@##@@#@#@###@"), (4, 1, "ghp_@#@@#@##@@@#@#@@@##@@#@#@@"), (4, 1, "@@#@##@@#@/@#+@@##@@@#@#@@=="), (4, 1, "pw-@#@#-@#@#@#@#"), (4, 1, "xoxb#@#@##@@#@#@##"), (4, 1, "################@"), (4, 1, "Zz##@@_@@##@@@#@#@"),
    (4, 0, "section-#-of-the-long-page"), (4, 0, "##################################"), (4, 0, "chapter_##_and_verse_#"), (4, 0, "a/path/to/some/file/##"),
)
#: What is left and right, and the kinds that a value there may be of; for others it makes another thing of it.
CONTEXTS = (
    ("", " ", "0123"), (" ", ".", "0123"), ("is ", ",", "0123"), ("the ", "!", "0123"), ("write to ", " or", "0123"), ("contact ", " for", "0123"), ("call ", " ", "0123"), ("tel ", ".", "0123"), ("fax ", ",", "0123"), ("host ", " is", "0123"), ("server ", " ", "0123"), ("card ", " ", "0123"), ("pay ", "!", "0123"),
    ("token = \"", "\"", "01234"), ("api_key: ", " ", "01234"), ("secret=", "\n", "01234"), ("Bearer ", " ", "01234"), ("password is ", " ", "01234"),
    ("order ", " ", ""), ("serial ", " ", ""), ("isbn ", " ", ""), ("version ", ".5", ""), ("no ", " ", ""), ("date ", "-1", ""), ("A", "b", ""), ("f", " ", ""), ("x1.", ".7", ""), ("AB", "9x", ""), (" ", "_1", ""),
)


def _example(number: Column, text: Column) -> Column:
    """The value with digits and letters of a hash of the number in place of its marks."""
    hashed = F.md5(number.cast("string").cast("binary"))
    random, letters = F.translate(hashed, "abcdef", "012345"), F.translate(hashed, "0123456789", "abcdefabcd")
    at = lambda i: (1 + i % 32).cast("int")
    body = F.transform(F.split(text, ""), lambda c, i: F.when(c == "#", F.substring(random, at(i), F.lit(1))).when(c == "@", F.substring(letters, at(i), F.lit(1))).when(c.isin("C", "X") & (i == F.char_length(text) - 1), F.lit("")).otherwise(c))
    out = F.array_join(body, "")
    need = (10 - luhn_sum(F.concat(digits(out), F.lit("0"))) % 10) % 10
    return F.concat(out, F.when(F.endswith(text, F.lit("#C")), need.cast("string")).when(F.endswith(text, F.lit("#X")), ((need + 3) % 10).cast("string")).otherwise(F.lit("")))


def examples(spark: SparkSession, count: int = EXAMPLES) -> DataFrame:
    """kind, mask, label, fold and n of count examples of each value in each context. A kind's mask is in one fold."""
    values = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(y).alias("good"), F.lit(t).alias("text")) for k, y, t in VALUES))
    contexts = F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("r"), F.lit(c).alias("fits")) for a, b, c in CONTEXTS))
    rows = spark.range(0, count, 1, 1).select("id", F.explode(values).alias("value")).select("id", "value.*", F.explode(contexts).alias("context")).select("id", "kind", "good", "text", "context.*")
    label = F.col("good") * F.contains("fits", F.col("kind").cast("string")).cast("int")
    rows = rows.select("kind", label.alias("label"), _example(F.xxhash64("id", "text", "l", "r"), F.col("text")).alias("v"), "l", "r")
    made = rows.select("kind", mask(features(F.col("kind"), F.col("v"), F.col("l"), F.col("r"))).alias("mask"), "label")
    return made.groupBy("kind", "mask", "label", F.pmod(F.xxhash64("kind", "mask"), F.lit(FOLDS)).cast("int").alias("fold")).agg(F.count("*").alias("n"))


class Model:
    """Trees as (bit, bit, four leaves), the start, and a threshold for each kind."""

    def __init__(self, start: float = 0.0) -> None:
        self.trees: list[tuple[int, int, list[float]]] = []
        self.start, self.thresholds = start, [math.inf] * len(KINDS)
        self.held_out: list = []  # kind, label, n and score of the examples, each by trees that did not see its mask

    def score(self, m: Column) -> Column:
        total = F.lit(self.start)
        for a, b, leaves in self.trees:
            leaf = F.shiftright(m, a).bitwiseAND(1) + 2 * F.shiftright(m, b).bitwiseAND(1)
            total = total + F.element_at(F.array(*map(F.lit, leaves)), leaf + 1)
        return total

    @classmethod
    def fit(cls, spark: SparkSession, rounds: int = ROUNDS) -> Model:
        """Newton boosting of a model without each fold, and of one with all, in the same jobs.

        The best pair of bits of a round is found by one aggregation over the distinct masks.
        """
        table = staged(examples(spark), "examples")
        number = len(features(*(F.lit("").cast(t) for t in ("int", "string", "string", "string"))))
        every = F.array(*map(F.lit, range(FOLDS + 1)))  # the last one is of no fold
        train = staged(table.select("mask", "label", "n", "fold", F.explode(every).alias("model")).where("model <> fold"), "examples")
        counts = {r.model: (r.good, r.n) for r in train.groupBy("model").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()}
        models = [cls(math.log(g / (n - g))) for g, n in (counts[k] for k in range(FOLDS + 1))]

        def of_model(m: Column) -> Column:
            """The score by the model of the row: the trees are data here, so that each round runs the same code."""
            tree = lambda a, b, w: f"named_struct('a', {a}, 'b', {b}, 'w', array({', '.join(f'{x!r}D' for x in w)}))"
            each = ", ".join(f"named_struct('start', {x.start!r}D, 'trees', array({', '.join(tree(*t) for t in [(0, 0, [0.0] * 4), *x.trees])}))" for x in models)
            own = F.element_at(F.expr(f"array({each})"), F.col("model") + 1)
            bit = lambda j: F.call_function("shiftright", m, j).bitwiseAND(1)
            return F.aggregate(own["trees"], own["start"], lambda acc, t: acc + F.element_at(t["w"], bit(t["a"]) + 2 * bit(t["b"]) + 1))

        pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(number) for b in range(a)))
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-of_model(F.col("mask"))))
            rows = train.select("model", "mask", ((F.col("label") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
            rows = rows.select("model", "g", "h", "mask", F.explode(pairs).alias("pair")).select("model", "g", "h", "mask", "pair.a", "pair.b")
            leaf = F.expr("(shiftright(mask, a) & 1) + 2 * (shiftright(mask, b) & 1)").cast("int")
            cells = rows.groupBy("model", "a", "b", leaf.alias("leaf")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            gain = F.round(F.sum(F.col("g") ** 2 / (F.col("h") + 1)), 9).alias("gain")
            best = cells.groupBy("model", "a", "b").agg(gain, F.collect_list(F.struct("leaf", (SHRINK * F.col("g") / (F.col("h") + 1)).alias("w"))).alias("leaves"))
            for r in best.groupBy("model").agg(F.max(F.struct("gain", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), "leaves")).alias("top")).collect():
                leaves = [0.0] * 4
                for x in r.top.leaves:
                    leaves[x.leaf] = x.w
                models[r.model].trees.append((-r.top.a, -r.top.b, leaves))
        out = models[FOLDS]
        out.held_out = table.withColumn("model", F.col("fold")).select("kind", "label", "n", of_model(F.col("mask")).alias("score")).orderBy(F.desc("score"), "label").collect()
        for kind in range(len(KINDS)):
            good = seen = 0
            rows = [r for r in out.held_out if r.kind == kind]
            for r, after in zip(rows, [*rows[1:], None]):
                good, seen = good + r.label * r.n, seen + r.n
                if good >= PRECISION * seen and (after is None or after.score < r.score):
                    out.thresholds[kind] = r.score
        return out


def _selected(base: Column, more: Column) -> Column:
    """Base, and of more, best first, what overlaps neither base nor what is selected before.

    All are put in order of their starts and cut where nothing overlaps, so that only neighbours are compared.
    """
    one = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))
    kind = "array<struct<s:int,k:int,e:int>>"
    fixed = F.transform(base, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), F.lit(None).cast("double").alias("score")))
    every = F.array(F.array_sort(F.concat(fixed, F.transform(more, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["score"].alias("score"))))))
    clash = lambda acc, c: F.exists(acc, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"]))

    def group(xs: Column) -> Column:
        start = F.transform(F.filter(xs, lambda c: c["score"].isNull()), one)
        order = F.array_sort(F.transform(F.filter(xs, lambda c: c["score"].isNotNull()), lambda c: F.struct((-c["score"]).alias("rank"), (c["s"] - c["e"]).alias("size"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
        return F.aggregate(order, start, lambda acc, c: F.when(clash(acc, c), acc).otherwise(F.concat(acc, F.array(one(c)))))

    def cut(xs: Column) -> Column:
        def step(end: Column, i: Column) -> tuple[Column, Column]:
            c = F.get(xs, i)
            return F.greatest(end, c["e"]), F.when(c["s"] >= end, F.array(i)).otherwise(F.array().cast("array<int>"))

        return folded(F.size(xs), F.lit(0), step, "array<int>")

    def done(xs: Column) -> Column:
        ends = lambda at: F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(xs)))
        pairs = F.element_at(F.transform(F.array(cut(xs)), lambda at: F.arrays_zip(at.alias("a"), ends(at).alias("b"))), 1)
        return F.flatten(F.transform(pairs, lambda p: group(F.slice(xs, p["a"] + 1, p["b"] - p["a"]))))

    return F.element_at(F.transform(every, done), 1).cast(kind)


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _found(docs: DataFrame, model: Model) -> DataFrame:
    """docs as a column `row`, with `__n0` to `__n3`, `__base` and `__all`: numbers of base spans, base spans, and all spans."""
    kind = "array<struct<s:int,k:int,e:int>>"
    spans = lambda x, k: F.transform(x, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), (m["s"] + F.char_length(m["v"])).alias("e")))
    text = F.when(F.rlike(F.coalesce("text", F.lit("")), F.lit(ANY)), F.col("text"))
    own = docs.select(F.struct("*").alias("row"), text.alias("__text"))
    found = own.select("row", *(F.filter(located(F.col("__text"), p, 0), _base_rule(k)).alias(f"__base{k}") for k, p in enumerate(BASE)), *(located(F.col("__text"), p, 1).alias(f"__more{k}") for k, p in enumerate(GENERATORS)))
    marked = []
    for k in range(len(KINDS)):
        one = F.transform(F.col(f"__more{k}"), lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), (m["s"] + F.char_length(m["v"])).alias("e"), mask(features(F.lit(k), m["v"], m["l"], m["r"])).alias("mask")))
        scored = F.transform(one, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e"), model.score(m["mask"]).alias("score")))
        marked.append(F.filter(scored, lambda m: m["score"] >= F.lit(float(min(model.thresholds[k], 1e300)))))
    empty = F.array().cast(kind)
    joined = found.select("row", *(F.size(f"__base{k}").alias(f"__n{k}") for k in range(len(BASE))), F.concat(*(spans(F.col(f"__base{k}"), k).cast(kind) for k in range(len(BASE)))).alias("__base"), F.concat(*marked).alias("__more"))
    number = lambda k: F.greatest(F.coalesce(f"__n{k}", F.lit(0)), F.lit(0)).cast("long").alias(f"__n{k}")
    every = F.when(F.size("__more") > 0, _selected(F.col("__base"), F.col("__more"))).otherwise(F.coalesce("__base", empty))
    return joined.select("row", *map(number, range(len(BASE))), F.coalesce("__base", empty).alias("__base"), every.alias("__all"))


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans and n_spans (all)."""
    out = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model or Model.fit(docs.sparkSession))
    return out.select("row.doc_id", *(F.col(f"__n{k}").alias(f"n_{name}") for k, name in enumerate(KINDS[: len(BASE)])), F.sha2(_told(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _told(F.col("__all")).alias("spans"), F.size("__all").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, with all their columns, with each span replaced by its kind in brackets; n_chars, if there is one, follows.

    Where spans overlap, what is left of the later one is part of the same replacement.
    """
    found = _found(docs, model or Model.fit(docs.sparkSession))
    names, text = F.array(*(F.lit(f"[{name.upper()}]") for name in KINDS)), F.coalesce("row.text", F.lit(""))
    bound = F.array(F.struct(text.alias("t"), F.array_sort("__all").alias("a")))

    def step(x: Column):
        def one(acc: Column, c: Column) -> Column:
            before = F.concat(acc["out"], F.substring(x["t"], acc["at"] + 1, c["s"] - acc["at"]), F.get(names, c["k"]))
            return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), F.when(c["s"] >= acc["at"], before).otherwise(acc["out"]).alias("out"))

        return one

    def done(x: Column) -> Column:
        end = F.aggregate(x["a"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step(x))
        return F.transform(F.array(end), lambda e: F.concat(e["out"], F.substring(x["t"], e["at"] + 1, F.char_length(x["t"]))))[0]

    new = F.when(F.size("__all") > 0, F.element_at(F.transform(bound, done), 1)).otherwise(F.col("row.text"))
    out = found.withColumn("__new", new)
    made = {"text": F.col("__new")} | ({"n_chars": F.char_length(F.coalesce("__new", F.lit(""))).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns))
