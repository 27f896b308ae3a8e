"""Personal data: high-recall candidates, boosted trees on format and context, redaction.

Generators propose overlapping spans of four kinds. The base patterns with their checks always
count; the other candidates (dotted or spaced card numbers, national phone numbers, spelt-out
addresses, long ip addresses) count if boosted trees score them above a threshold calibrated on
rows that the trees have not seen, of all documents. All of it is DataFrame functions and one narrow pass: a
document's candidates stay in its row, and the trained trees become conditional expressions.

There are no labels for personal data, so truth is planted: each document gives windows of its text
into which personal data of each kind is written in the wide formats, and windows into which
look-alikes are (numbers whose checksum fails, dates, versions, ratios, order numbers), with words
around that announce or deny more or less reliably. Trees see format and neighbouring words of the
candidates that the generators find there, not what was planted. Candidates of all documents are
grouped by their few-valued features, so what is left is bounded: half of the windows, by a hash,
fit the trees, the others set the thresholds. ``measured`` tells recall and precision on the others.
Without any document there are no trees, and base spans alone count.

Null counts as empty, which has no spans. Each row is judged alone, so repeated rows and repeated
or null ids need no care. Positions are code points, the end exclusive. Very long
texts are judged whole; a text's candidates are compared with each other, so one text with tens of
thousands of them is slow.
"""

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.let import let
from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored, unused

TREES = 16
TREE_DEPTH = 3
STEP = 0.3
#: Share of true spans that a threshold must reach on held-out candidates of the wide formats.
PRECISION = 0.95
CONTEXT_CHARS = 24

KINDS = ("email", "ip", "card", "phone")

# The base patterns. A run of characters that a match could begin in is entered at its start only,
# and repeats don't give back what they took, so the search is linear in the text.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text with a base match passes.
HINT = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
    "phone": r"\+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[a-z0-9-]{1,63}+"
    r"(?: ?[(\[]dot[)\]] ?[a-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}+:){7}+[0-9a-f]{1,4}+(?![0-9a-f:])",
    "card": r"(?<![0-9])(?<![0-9]\.)[0-9]{4}+(?:[. /][0-9]{4}+){3}+(?!\.?[0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{2,5}\)|[0-9]{2,5}+)(?:[ ./-]{1,2}[0-9]{2,5}+){2,4}+(?![0-9])",
}
WIDE_HINT = {
    "email": r"(?i)[(\[]at[)\]]",
    "ip": r"(?i)[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]",
    "card": r"[0-9]{4}[. /][0-9]{4}[. /][0-9]{4}",
    "phone": r"[0-9]{2}\)?[ ./-]{1,2}[0-9]{2,5}[ ./-]{1,2}[0-9]{2}",
}
ANNOUNCED = {
    "email": r"(?i)mail|contact|write|@",
    "ip": r"(?i)\bip\b|host|server|addr|ping",
    "card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobil|fax|sms",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

DENIED = r"(?i)order|invoice|serial|isbn|version|date|total|page|ratio|score|\bno\b|\bnr\b|\bref\b"

FEATURES = (
    "kind", "digits", "holds", "announced", "denied", "clean", "separators", "one_separator", "prefix",
    "first_group", "last_group", "leading_zero", "letters",
)
_SPANS = "array<struct<start:int,kind:int,end:int,wide:int,found:string>>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _holds(kind: str, found: Column) -> Column:
    """Whether the check of a kind holds for a match of its base pattern."""
    digits = _digits(found)
    return {
        "email": F.lit(True),
        "ip": found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _matches(text: Column, hint: str, pattern: str, kind: int, wide: int) -> Column:
    """Matches from left to right with their positions.

    Splitting at the pattern gives what lies between the matches; positions are sums of both
    lengths, added up in blocks so that a text with very many matches stays cheap.
    """
    block = 64
    empty = F.array().cast(_SPANS)

    def of(between: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))
        add = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)

        def placed(lengths: Column, blocks: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                whole = F.floor(i / block).cast("int")
                before = add(F.slice(blocks, 1, whole)) + add(
                    F.slice(lengths, whole * block + 1, i % block)
                )
                start = before + F.length(F.get(between, i))
                return F.struct(
                    start.alias("start"),
                    F.lit(kind).alias("kind"),
                    (start + F.length(m)).alias("end"),
                    F.lit(wide).alias("wide"),
                    m.alias("found"),
                )

            return F.transform(found, span)

        return let(
            lengths,
            lambda lengths: let(
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
                    lambda b: add(F.slice(lengths, b * block + 1, block)),
                ),
                lambda blocks: placed(lengths, blocks),
            ),
        )

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(
            F.size(found) > 0, let(F.split(text, pattern, -1), lambda between: of(between, found))
        ).otherwise(empty),
    )
    hinted = text.contains(hint) if hint == "@" else text.rlike(hint)
    return F.when(hinted, found).otherwise(empty)


def _base(text: Column) -> list[Column]:
    return [_matches(text, HINT[k], BASE[k], n, 0) for n, k in enumerate(KINDS)]


def _wide(text: Column) -> list[Column]:
    return [_matches(text, WIDE_HINT[k], WIDE[k], n, 1) for n, k in enumerate(KINDS)]


def _by_kind(kind: Column, of) -> Column:
    first, *rest = [(n, of(k)) for n, k in enumerate(KINDS)]
    chosen = F.when(kind == first[0], first[1])
    for n, value in rest:
        chosen = chosen.when(kind == n, value)
    return chosen


def _base_holds(span: Column) -> Column:
    return _by_kind(span["kind"], lambda k: _holds(k, span["found"]))


def _features(span: Column, text: Column) -> dict[str, Column]:
    """Few-valued features of format and neighbouring words, for a wide candidate."""
    found, kind = span["found"], span["kind"]
    before = F.substring(
        text, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)) + 1,
        F.least(span["start"], F.lit(CONTEXT_CHARS)),
    )
    around = F.concat(
        F.substring(text, F.greatest(span["start"], F.lit(1)), F.least(span["start"], F.lit(1))),
        F.lit(" "),
        F.substring(text, span["end"] + 1, F.lit(1)),
    )
    digits = _digits(found)
    marks = F.regexp_replace(found, "[A-Za-z0-9_%@+:]", "")
    checked = _by_kind(
        kind,
        lambda k: {
            "email": found.rlike(r"(?i)[\])] ?(?:com|net|org|edu|gov|info|[a-z]{2})$"),
            "ip": F.lit(True),
            "card": _holds("card", found),
            "phone": F.length(digits).between(9, 13),
        }[k],
    )
    return {
        "kind": kind,
        "digits": F.least(F.length(digits), F.lit(20)),
        "holds": checked.cast("int"),
        "announced": _by_kind(kind, lambda k: before.rlike(ANNOUNCED[k])).cast("int"),
        "denied": before.rlike(DENIED).cast("int"),
        "clean": (~around.rlike("[A-Za-z0-9]")).cast("int"),
        "separators": F.least(F.length(marks), F.lit(6)),
        "one_separator": (F.length(marks) == F.length(F.regexp_extract(marks, r"^(.)\1*$", 0))).cast("int"),
        "prefix": F.when(found.startswith("+"), 2).when(found.startswith("("), 1).otherwise(0),
        "first_group": F.least(F.length(F.regexp_extract(found, "[A-Za-z0-9]+", 0)), F.lit(6)),
        "last_group": F.least(F.length(F.regexp_extract(found, "[A-Za-z0-9]+$", 0)), F.lit(6)),
        "leading_zero": digits.startswith("0").cast("int"),
        "letters": F.least(F.length(F.regexp_replace(found, "[^A-Za-z]", "")), F.lit(4)),
    }


@dataclass(frozen=True)
class Trees:
    """Boosted trees as nested (feature, threshold, low, high) or leaf values, with weights."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def score(self, features: dict[str, Column] | Column) -> Column:
        """Probability that a candidate is personal data, from its features by name."""

        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, low, high = node
            return F.when(features[FEATURES[feature]] <= threshold, value(low)).otherwise(value(high))

        margin = reduce(
            lambda a, b: a + b,
            [value(t) * w for t, w in zip(self.trees, self.weights, strict=True)],
            F.lit(0.0),
        )
        return 1 / (1 + F.exp(-2 * margin))


def _tree(lines: list[str]):
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)  # Else
    return (int(feature), float(threshold), low, _tree(lines))


#: What planted personal data and look-alikes are made of.
ANNOUNCING = {
    "email": ("mail", "e-mail:", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit card", "Karte"),
    "phone": ("phone", "tel.", "call", "mobil", "fax:"),
}
DENYING = ("order", "invoice", "serial", "version", "date", "total", "page", "ratio", "score", "ref")
NAMES = ("anna", "j.smith", "office", "luis", "marie", "k_weber", "sales", "tom")
PLACES = ("post", "example", "my-host", "firma", "lab", "shop24", "univ", "corner")
DOMAINS = ("com", "net", "org", "de", "fr", "es", "info", "museum")
NO_DOMAINS = ("7", "12", "x", "notation", "plots3", "product")
LEFT_CHARS, RIGHT_CHARS = 40, 16


def planted(docs: DataFrame) -> DataFrame:
    """Windows of all texts with something planted in each, eight to a text.

    ``window``, ``kind``, ``truth`` (personal data or a look-alike), ``start`` and ``end`` of what is
    planted, and ``held_out``. All of it follows from the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def cut(text: Column, seed: Column, n: Column) -> Column:
        at = F.pmod(seed, F.length(text) + 1).cast("int")
        return F.struct(
            (n % len(KINDS)).alias("kind"), (n >= len(KINDS)).alias("truth"), seed.alias("seed"),
            F.substring(text, F.greatest(at - LEFT_CHARS, F.lit(0)) + 1, F.least(at, F.lit(LEFT_CHARS))).alias("left"),
            F.substring(text, at + 1, F.lit(RIGHT_CHARS)).alias("right"),
        )

    cuts = docs.select(
        F.explode(
            let(F.struct(text.alias("text"), F.xxhash64(text).alias("seed")), lambda t: F.transform(
                F.sequence(F.lit(0), F.lit(2 * len(KINDS) - 1)),
                lambda n: let(F.xxhash64(t["seed"], n), lambda seed: cut(t["text"], seed, n)),
            ))
        ).alias("cut")
    ).select("cut.*")

    draws = iter(range(1000))
    drawn = lambda below: F.pmod(F.xxhash64("seed", F.lit(next(draws))), F.lit(below))
    pick = lambda values: F.element_at(
        F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (drawn(len(values)) + 1).cast("int")
    )
    digits = lambda n: F.lpad(drawn(10**n).cast("string"), n, "0")
    often = lambda eighths: drawn(8) < eighths
    at = lambda: pick(("(at)", " (at) ", " [at] ", "[at]"))
    dot = lambda: pick(("(dot)", " (dot) ", " [dot] "))

    def card(right_digit: bool) -> Column:
        body, mark, wrong = F.concat(pick(("4", "5")), digits(14)), pick((".", "/")), drawn(9) + 1
        check = lambda body: F.element_at(
            F.filter(
                F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.struct(d.alias("d"), F.concat(body, d.cast("string")).alias("n"))),
                lambda x: F.call_function("luhn_check", x["n"]),
            ), 1,
        )["d"]
        last = check(body) if right_digit else F.pmod(check(body) + wrong, F.lit(10))
        return F.regexp_replace(F.concat(body, last.cast("string")), F.lit("([0-9]{4})(?=[0-9])"), F.concat(F.lit("$1"), mark))

    real = {
        "email": F.concat(pick(NAMES), pick(("", ".k", "_7", "84")), at(), pick(PLACES), dot(), pick(DOMAINS)),
        "ip": F.concat_ws(":", *[F.lower(F.hex(drawn(1 << 16))) for _ in range(8)]),
        "card": card(True),
        "phone": pick((
            F.concat(F.lit("(0"), digits(2), F.lit(") "), digits(4), F.lit(" "), digits(4)),
            F.concat(F.lit("0"), digits(3), F.lit(" "), digits(3), F.lit(" "), digits(4)),
            F.concat(digits(3), F.lit("-"), digits(3), F.lit("-"), digits(4)),
            F.concat(F.lit("0"), digits(1), *[F.concat(F.lit(" "), digits(2)) for _ in range(4)]),
        )),
    }
    alike = {
        "email": F.concat(pick(PLACES), at(), pick(PLACES), dot(), pick(NO_DOMAINS)),
        "ip": F.concat_ws(":", *[F.lpad(drawn(60).cast("string"), 2, "0") for _ in range(8)]),
        "card": card(False),
        "phone": pick((
            F.concat(F.lit("20"), digits(2), F.lit("-"), digits(2), F.lit("-"), digits(2), F.lit(" "), digits(2)),
            F.concat_ws(".", digits(2), digits(2), digits(2)),
            F.concat_ws(" ", digits(3), digits(3), digits(3)),
            F.concat(F.lit("978-"), digits(2), F.lit("-"), digits(4), F.lit("-"), digits(3)),
        )),
    }
    kind, truth = F.col("kind"), F.col("truth")
    announcing = _by_kind(kind, lambda k: pick(ANNOUNCING[k]))
    denying = pick(DENYING)
    word = F.when(truth, F.when(often(6), announcing).otherwise("")).otherwise(
        F.when(often(1) | ((kind == KINDS.index("card")) & often(4)), announcing)
        .when(often(6), denying).otherwise("")
    )
    glued = F.when(~truth & often(1), "x").otherwise("")
    found = F.when(truth, _by_kind(kind, real.get)).otherwise(_by_kind(kind, alike.get))
    parts = cuts.select(
        "kind", "truth", "right", found.alias("found"), pick((" ", ", ", ". ", "; ")).alias("after"),
        F.concat(F.col("left"), F.lit(" "), word, F.lit(" "), glued).alias("before"),
        (drawn(2) == 0).alias("held_out"),
    )
    return parts.select(
        F.concat("before", "found", "after", "right").alias("window"), "kind", "truth", "held_out",
        F.length("before").alias("start"), (F.length("before") + F.length("found")).alias("end"),
    )


def _covers(span: Column) -> Column:
    """Whether a span is of the kind planted and covers it."""
    return (span["kind"] == F.col("kind")) & (span["start"] <= F.col("start")) & (span["end"] >= F.col("end"))


def _touches(span: Column) -> Column:
    return (span["start"] < F.col("end")) & (span["end"] > F.col("start"))


def train(docs: DataFrame) -> Trees:
    """Trees and thresholds from what is planted in windows of all documents."""
    window, span = F.col("window"), F.col("span")
    spans = (
        planted(docs)
        .select("*", F.explode(F.concat(*_wide(window))).alias("span"))
        # Of other candidates, those of the text itself, the truth is not known.
        .where(_touches(span))
        .select(
            F.struct(*[v.cast("int").alias(k) for k, v in _features(span, window).items()]).alias("f"),
            "held_out",
            (F.col("truth") & _covers(span)).cast("int").alias("label"),
        )
        .select("f.*", "held_out", "label")
    )
    # Few-valued features: the table of their combinations is bounded however many rows there are.
    cells = stored(
        spans.groupBy(*FEATURES, "held_out", "label").agg(F.count("*").cast("double").alias("weight")),
        "pii-cells",
    )
    fit = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cells.where("NOT held_out"))
    if fit.select("label").distinct().count() < 2:
        # No documents to plant anything in: nothing beyond the base spans.
        return Trees((), (), (2.0,) * len(KINDS))
    model = GBTClassifier(
        labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=STEP, seed=1
    ).fit(fit)
    trees = tuple(_tree(t.toDebugString.split("\n")[1:]) for t in model.trees)
    found = Trees(trees, tuple(model.treeWeights), ())
    # A kind that has candidates only where the trees were fitted goes by those.
    unseen = cells.groupBy("kind").agg(F.max("held_out").alias("unseen"))
    scored = (
        cells.join(unseen, "kind").where("held_out = unseen")
        .withColumn("score", found.score({c: F.col(c) for c in FEATURES}))
        .groupBy("kind", "score")
        .agg(F.sum("weight").alias("all"), F.sum(F.col("weight") * F.col("label")).alias("good"))
        .collect()
    )
    return Trees(trees, found.weights, tuple(_threshold(scored, n) for n in range(len(KINDS))))


def measured(docs: DataFrame, trees: Trees) -> DataFrame:
    """For each kind, on windows held out: ``planted``, of these ``caught``; spans ``added``, of these ``right``."""
    found = planted(docs).where("held_out").withColumn("spans", _spans(F.col("window"), trees))
    every = F.concat("spans.base", "spans.added")
    return found.select(
        "kind",
        F.col("truth").cast("long").alias("planted"),
        (F.col("truth") & F.exists(every, _covers)).cast("long").alias("caught"),
        F.size(F.filter("spans.added", lambda s: (s["kind"] == F.col("kind")) & _touches(s))).cast("long").alias("added"),
        F.when(F.col("truth"), F.size(F.filter("spans.added", _covers))).otherwise(0).cast("long").alias("right"),
    ).groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("planted", "caught", "added", "right")])


def _threshold(scored, kind: int) -> float:
    """The lowest score from which on the wide candidates of a kind reach the precision."""
    found, every, good = 2.0, 0.0, 0.0
    for row in sorted((r for r in scored if r.kind == kind), key=lambda r: -r.score):
        every, good = every + row["all"], good + row["good"]
        if good >= PRECISION * every:
            found = row.score
    return max(found, 0.5)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _spans(text: Column, trees: Trees) -> Column:
    """struct(base, added): checked base spans of each kind, and scored others clear of them."""
    base = F.filter(F.concat(*_base(text)), _base_holds)
    candidates = F.concat(*_wide(text))

    def scored(base: Column) -> Column:
        clear = F.filter(candidates, lambda c: ~F.exists(base, lambda b: _overlap(b, c)))
        with_score = F.transform(
            clear,
            lambda c: let(
                F.struct(*[v.alias(k) for k, v in _features(c, text).items()]),
                lambda features: F.struct(
                    trees.score(features).alias("score"),
                    c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
                ),
            ),
        )
        threshold = lambda c: _by_kind(c["kind"], lambda k: F.lit(trees.thresholds[KINDS.index(k)]))
        return F.filter(with_score, lambda c: c["score"] >= threshold(c))

    def best(scored: Column) -> Column:
        # In the order of their scores, each unless it overlaps one that is taken: what is dropped
        # itself stands in nobody's way.
        ordered = F.array_sort(F.transform(
            scored,
            lambda c: F.struct(
                (-c["score"]).alias("worse"), c["start"].alias("start"), c["kind"].alias("kind"),
                c["end"].alias("end"),
            ),
        ))
        return let(ordered, lambda ordered: F.aggregate(
            ordered,
            F.slice(ordered, 1, 0),
            lambda taken, c: F.when(F.exists(taken, lambda o: _overlap(o, c)), taken)
            .otherwise(F.concat(taken, F.array(c))),
        ))

    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    return let(
        base,
        lambda base: F.struct(
            F.array_sort(F.transform(base, plain)).alias("base"),
            F.when(F.lit(not trees.trees), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
            .otherwise(let(scored(base), lambda s: F.transform(best(s), plain))).alias("added"),
        ),
    )


def with_spans(docs: DataFrame, trees: Trees) -> DataFrame:
    """The documents and ``spans``, a struct of ``base`` and ``added`` (start, kind, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("spans", _spans(text, trees))


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans replaced by the kind of its first."""
    joined = F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:int,kind:int,end:int>>"),
        lambda done, s: let(
            F.get(done, F.size(done) - 1),
            lambda last: F.when(
                last.isNotNull() & (s["start"] < last["end"]),
                F.concat(
                    F.slice(done, 1, F.size(done) - 1),
                    F.array(F.struct(
                        last["start"].alias("start"), last["kind"].alias("kind"),
                        F.greatest(last["end"], s["end"]).alias("end"),
                    )),
                ),
            ).otherwise(F.concat(done, F.array(s))),
        ),
    )
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuilt(joined: Column) -> Column:
        end_before = lambda i: F.coalesce(F.get(joined, i - 1)["end"], F.lit(0))
        parts = F.transform(
            joined,
            lambda s, i: F.concat(
                F.substring(text, end_before(i) + 1, s["start"] - end_before(i)), F.get(name, s["kind"])
            ),
        )
        last = F.coalesce(F.get(joined, F.size(joined) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    return let(joined, rebuilt)


def redacted(docs: DataFrame, trees: Trees) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars`` follows the text.

    Documents without any, and null texts, stay as they are.
    """
    spans = unused("spans", docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    with_them = docs.withColumn(
        spans, let(_spans(text, trees), lambda s: F.concat(s["base"], s["added"]))
    )
    changed = F.size(spans) > 0
    new = F.when(changed, _redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = with_them.withColumn("text", new)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars",
            F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")),
        )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@registered()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document."""
    docs = table(spark, sf_dir, "documents")
    found = with_spans(docs.select("doc_id", "text"), train(docs))
    base = F.col("spans.base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("spans.base", "spans.added"))).alias("spans"),
    )
