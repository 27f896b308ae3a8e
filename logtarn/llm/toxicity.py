"""Toxicity: a lexicon trie crossed with Levenshtein automata, context windows, a logistic score.

The lexicon is learned from labelled documents: words, and beginnings of words, that toxic
documents have far more often than others. The trie of the lexicon is crossed with the automaton
that allows edits (one in words of five letters or more, two from nine on; a letter put in, left
out or changed, or two neighbours swapped, at any place), and the product is made deterministic, so
all words of a megabyte of texts run through one table side by side. Words are runs of letters,
marks and digits by their Unicode category, and may have single symbols between letters. The window
around a hit tells abuse from quotation: quotation marks that open before and close after it, words
of reporting, words of address. A document's hits are summed up in a few figures, which a logistic
regression turns into a score.

The lexicon counts the labelled documents outside the held-out fifth, one of near copies; beyond
about ``LABELLED`` of them, so many drawn by a hash of the id. The weights are fitted on about ``TOXIC`` toxic and ``OTHER`` other ones of these, and on copies of the
toxic ones whose terms are misspelled or addressed to someone (still toxic) or quoted (not).
Scoring covers all documents and whole texts. Neither labels nor language, source or id enter a
score. Null or empty text has no hits and gets the score of a text without hits. Without labels of
both kinds there is no lexicon, and every score is near 1 if all labels say toxic, else near 0.
Rows may repeat; each is scored alone. A null id is never held out.
"""

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored
from logtarn.llm.textbytes import named, owner, pieces, runs, utf8
from logtarn.llm.winnowing import minima, words_of

#: Labelled documents to learn from: about so many for the lexicon, so many of each label for the weights.
LABELLED = 500_000
TOXIC = 3000
OTHER = 6000
TERMS = 256
STEMS = (3, 4, 5, 6, 7, 8)
#: Least log-odds of a word and of a stem, by so many standard errors, and the share of toxic
#: texts that must have it.
ERRORS = 1.5
LOG_ODDS, STEM_LOG_ODDS = 3.0, 2.0
SHARE, STEM_SHARE = 0.005, 0.02
#: Letters that a word must have for one edit, and for two.
FUZZY_LENGTHS = (5, 9)
#: Symbols that stand for a letter between two others.
INNER = "!$@*"
CONTEXT_CHARS = 40
FOLDS = 5

QUOTES = "\"“”„«»‘’"
#: Words that report someone's speech, and words that address someone, in the languages at hand.
REPORTING = r"\b(?:said|says|wrote|called|quoted|sagte|schrieb|nannte|dit|écrit|dijo|escribió)\b"
ADDRESS = r"\b(?:you|your|du|dich|dein|ihr|toi|vous|eres|usted|tú)\b"


@dataclass(frozen=True)
class Lexicon:
    """Words and stems (beginnings of words) with the log-odds of toxic documents to others."""

    words: dict[str, float]
    stems: dict[str, float]


@dataclass(frozen=True)
class Machine:
    """Deterministic product automaton. State 0 is dead, 1 the start."""

    table: np.ndarray
    classes: np.ndarray
    kind: np.ndarray  # of a word that ends in a state: 0 none, 1 exact, 2 stem, 3 misspelled
    weight: np.ndarray


def word_points() -> np.ndarray:
    """Marks the code points that words consist of: letters, marks and digits."""
    return np.array([unicodedata.category(chr(p))[0] in "LMN" for p in range(0x110000)])


def machine(lexicon: Lexicon) -> Machine:
    """The lexicon's trie crossed with the automata for edits."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, float] = {}
    stems: dict[int, float] = {}
    spare = [0]  # edits that a word through a node may have
    allowed: dict[int, int] = {}  # and that the word ending at a node may have
    for entries, mark in ((lexicon.words, ends), (lexicon.stems, stems)):
        for word, weight in sorted(entries.items()):
            node, path = 0, [0]
            for letter in word:
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    spare.append(0)
                node = children[node][letter]
                path.append(node)
            mark[node] = weight
            if mark is ends:
                allowed[node] = sum(len(word) >= least for least in FUZZY_LENGTHS)
                for step in path:
                    spare[step] = max(spare[step], allowed[node])

    # A state of one automaton: the node reached, the edits made, and the first of two swapped
    # letters if it is still to come.
    def closed(states: set[tuple[int, int, str]]) -> frozenset[tuple[int, int, str]]:
        """With the letters of the trie that an edit leaves out, without what fewer edits reach."""
        waiting = list(states)
        while waiting:
            node, edits, awaited = waiting.pop()
            for child in children[node].values() if not awaited else ():
                left_out = (child, edits + 1, "")
                if spare[child] > edits and left_out not in states:
                    states.add(left_out)
                    waiting.append(left_out)
        return frozenset(s for s in states if not any((s[0], e, s[2]) in states for e in range(s[1])))

    def after(states: frozenset[tuple[int, int, str]], letter: str) -> frozenset[tuple[int, int, str]]:
        reached = set()
        for node, edits, awaited in states:
            if awaited:
                if letter == awaited:
                    reached.add((node, edits, ""))
                continue
            if node in stems and not edits:
                reached.add((node, 0, ""))  # whatever follows a stem
            child = children[node].get(letter)
            if child is not None and (not edits or spare[child] >= edits):
                reached.add((child, edits, ""))
            if spare[node] <= edits:
                continue
            reached.add((node, edits + 1, ""))
            for other, child in children[node].items():
                if other == letter:
                    continue
                if spare[child] > edits:
                    reached.add((child, edits + 1, ""))
                swapped = children[child].get(letter)
                if swapped is not None and spare[swapped] > edits:
                    reached.add((swapped, edits + 1, other))
        return closed(reached)

    letters = sorted({letter for node in children for letter in node})
    classes = np.where(word_points(), 0, -1).astype(np.int16)
    classes[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
    start = closed({(0, 0, "")})
    numbers = {frozenset(): 0, start: 1}
    rows, waiting = {0: [0] * (len(letters) + 1)}, [start]
    while waiting:
        state = waiting.pop()
        row = []
        for letter in ["", *letters]:
            following = after(state, letter)
            if following not in numbers:
                numbers[following] = len(numbers)
                waiting.append(following)
            row.append(numbers[following])
        rows[numbers[state]] = row
    kind, weight = np.zeros(len(numbers), np.int8), np.zeros(len(numbers))
    for state, number in numbers.items():
        plain = [(n, e) for n, e, awaited in state if not awaited]
        found = [(1, ends[n]) for n, e in plain if n in ends and not e]
        found += [(2, stems[n]) for n, e in plain if n in stems and not e]
        found += [(3, ends[n]) for n, e in plain if n in ends and 0 < e <= allowed[n]]
        if found:
            best = min(k for k, _ in found)
            kind[number], weight[number] = best, max(w for k, w in found if k == best)
    return Machine(np.array([rows[n] for n in range(len(numbers))], np.int32), classes, kind, weight)


def _letters(
    column: pa.Array, in_words: np.ndarray
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, their code points end to end, text ends, begin and end of words."""
    column = pc.utf8_lower(column.fill_null("").cast(pa.large_string()))
    data, ends = utf8(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    ends = before[ends]
    inside = in_words[points]
    inner = np.flatnonzero(np.isin(points, [ord(x) for x in INNER]))
    inner = inner[(inner > 0) & (inner < len(points) - 1)]
    inner = inner[inside[inner - 1] & inside[inner + 1]]
    at = owner(inner, ends)
    inside[inner[(inner > ends[at]) & (inner + 1 < ends[at + 1])]] = True
    return column, points, ends, *runs(inside, ends)


#: Hits and hits per hundred words, by sort; then shares of hits by context. Densities and the
#: strongest term leave out hits in quotation marks.
FIGURES = (
    "exact", "stems", "misspelled", "exact_density", "stem_density", "misspelled_density",
    "strongest", "addressed", "quoted", "reported",
)
#: Figures up to here never speak for a clean text, the others never for a toxic one.
EVIDENCE = FIGURES.index("quoted")


def in_quotes(left: str, word: str, right: str) -> bool:
    """Whether the last quotation mark before a word opens and the first one after it closes."""
    around = left + word + right
    marks = [
        i for i, x in enumerate(around)
        if x in QUOTES and not (0 < i < len(around) - 1 and around[i - 1].isalnum() and around[i + 1].isalnum())
    ]
    opening = max((i for i in marks if i < len(left)), default=None)
    closing = min((i for i in marks if i >= len(left) + len(word)), default=None)
    if opening is None or closing is None:
        return False
    return not (opening and around[opening - 1].isalnum()) and not around[opening + 1].isspace() and (
        not around[closing - 1].isspace() and not around[closing + 1 : closing + 2].isalnum()
    )


@dataclass(frozen=True)
class Hits:
    """Terms found in texts: the text of each, its sort and weight, begin and end in code points."""

    points: np.ndarray
    ends: np.ndarray
    words: np.ndarray  # of each text
    doc: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def hits(column: pa.Array, automaton: Machine) -> Hits:
    """Runs all words of the texts through the automaton."""
    texts, points, ends, begin, end = _letters(column, automaton.classes >= 0)
    state = np.ones(len(begin), np.int32)
    active = np.arange(len(begin))
    classes = np.maximum(automaton.classes[points], 0)
    step = 0
    while len(active):
        state[active] = automaton.table[state[active], classes[begin[active] + step]]
        step += 1
        active = active[(state[active] > 0) & (begin[active] + step < end[active])]
    found = np.flatnonzero(automaton.kind[state])
    return Hits(
        points, ends, np.bincount(owner(begin, ends), minlength=len(texts)), owner(begin[found], ends),
        automaton.kind[state[found]], automaton.weight[state[found]], begin[found], end[found],
    )


def figures(column: pa.Array, automaton: Machine) -> np.ndarray:
    """A row of figures for each text."""
    hit, texts = hits(column, automaton), len(column)
    found = np.zeros((texts, len(FIGURES)))
    if not len(hit.doc):
        return found
    context = np.zeros((len(hit.doc), 3))
    for i, (at, a, b) in enumerate(zip(hit.doc.tolist(), hit.begin.tolist(), hit.end.tolist(), strict=True)):
        low, high = max(a - CONTEXT_CHARS, hit.ends[at]), min(b + CONTEXT_CHARS, hit.ends[at + 1])
        left, word, right = (
            hit.points[x:y].tobytes().decode("utf-32-le") for x, y in ((low, a), (a, b), (b, high))
        )
        quoted = in_quotes(left, word, right)
        addressed = not quoted and bool(re.search(ADDRESS, left + " " + right))
        context[i] = addressed, quoted, bool(re.search(REPORTING, left))
    words, outside = np.maximum(hit.words, 1), context[:, 1] == 0
    for k in (1, 2, 3):
        of_sort = hit.kind == k
        count = np.bincount(hit.doc, of_sort & outside, texts)
        found[:, k - 1] = np.log1p(np.bincount(hit.doc, of_sort, texts))
        found[:, k + 2] = np.log1p(100 * count / words)
    np.maximum.at(found[:, 6], hit.doc, hit.weight * np.where(hit.kind == 3, 0.5, 1) * outside)
    np.add.at(found[:, 7:], hit.doc, context)
    found[:, 7:] /= np.maximum(np.bincount(hit.doc, minlength=texts), 1)[:, None]
    return found


def misspelt(word: str, variant: int) -> str:
    """The word with one edit in its middle."""
    at = len(word) // 2
    return (
        word[:at] + word[at + 1 :],
        word[:at] + "x" + word[at + 1 :],
        word[:at] + "x" + word[at:],
        word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :],
    )[variant % 4]


def rewritten(column: pa.Array, automaton: Machine, change) -> tuple[pa.Array, np.ndarray]:
    """The texts with each hit replaced by ``change(word, number of the hit)``, and which have hits."""
    hit = hits(column, automaton)
    out, changed = [], np.bincount(hit.doc, minlength=len(column)) > 0
    first = np.searchsorted(hit.doc, np.arange(len(column) + 1))
    for at in range(len(column)):
        parts, done = [], hit.ends[at]
        for i in range(first[at], first[at + 1]):
            a, b = hit.begin[i], hit.end[i]
            parts.append(hit.points[done:a].tobytes().decode("utf-32-le"))
            parts.append(change(hit.points[a:b].tobytes().decode("utf-32-le"), i - first[at] + at))
            done = b
        parts.append(hit.points[done : hit.ends[at + 1]].tobytes().decode("utf-32-le"))
        out.append("".join(parts))
    return pa.array(out, pa.string()), changed


#: What a copy weighs beside a labelled text.
COPY_WEIGHT = 0.1
#: Copies of toxic texts to learn from, and whether the copy is toxic.
COPIES = (
    (lambda word, i: misspelt(word, i) if len(word) >= FUZZY_LENGTHS[0] else word, 1),
    (lambda word, i: f"you {word}", 1),
    (lambda word, i: f"“{word}”" if i % 2 else f"said “{word}”", 0),
)


@dataclass(frozen=True)
class Model:
    automaton: Machine
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.empty(0)
        margin = figures(column, self.automaton) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fold(doc_id: Column) -> Column:
    """The fold of a row by its id; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``toxic`` of labelled documents outside the held-out fold, one of near copies.

    Labels of about ``LABELLED`` ids, so they go to the texts and no text is shuffled.
    """
    usable = stored(
        labels.where(fold(F.col("doc_id")) != 0).where("toxic IN (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")),
        "labels",
    )
    usable = usable.where(_place("doc_id") < LABELLED / max(usable.count(), 1))
    # Near copies mostly share their smallest shingle hash.
    copy = F.coalesce(F.array_min(minima(words_of(F.col("text")))), F.xxhash64("text"))
    drawn = stored(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(usable), "doc_id")
        .select("text", "toxic", copy.alias("copy"), F.monotonically_increasing_id().alias("row")),
        "labelled",
    )
    one = F.min(F.struct(F.xxhash64("text"), "toxic", "row"))
    chosen = stored(drawn.groupBy("copy").agg(one.alias("one")).select("one.row"), "chosen")
    # Ids that repeat could make these more than the bound.
    chosen = F.broadcast(chosen) if chosen.count() <= 2 * LABELLED else chosen
    return drawn.join(chosen, "row").select("text", "toxic")


def _place(column: str) -> Column:
    """A number from 0 to 1 by the hash of a value."""
    return F.xxhash64(column).bitwiseAND((1 << 30) - 1) / float(1 << 30)


def _counted(batches: Iterator[pa.RecordBatch], in_words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts have each word and each beginning of a word."""
    for batch in pieces(batches, 0):
        _, points, ends, begin, end = _letters(batch.column(0), in_words)
        toxic = batch.column(1).to_numpy()
        doc, length = owner(begin, ends), end - begin
        name = named(_between(points, begin, length).view(np.uint8), length * 4)
        # Each word of a piece is named once; beginnings are taken from the words, not the texts.
        _, example = np.unique(name, return_index=True)
        doc, name = _pairs(doc, name)
        first, length = begin[example], length[example]
        for size in (0, *STEMS):
            some = np.flatnonzero(length > size if size else length >= 3)
            if not len(some):
                continue
            sizes = np.full(len(some), size) if size else length[some]
            term = np.full(len(first), -1)
            term[some] = named(_between(points, first[some], sizes).view(np.uint8), sizes * 4)
            having = term[name] >= 0
            text, found = _pairs(doc[having], term[name[having]])
            every = np.bincount(found)
            share = np.bincount(found, toxic[text]).astype(np.int64)
            _, at = np.unique(term[some], return_index=True)
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(
                    [points[a : a + n].tobytes().decode("utf-32-le")
                     for a, n in zip(first[some[at]].tolist(), sizes[at].tolist(), strict=True)],
                    pa.string(),
                ),
                "stem": pa.array(np.full(len(at), bool(size))),
                "toxic": pa.array(share), "other": pa.array(every - share),
            })


def _between(points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The code points of each word, end to end."""
    return points[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())]


def _pairs(doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of text and name."""
    count = int(name.max(initial=0)) + 1
    return np.divmod(np.unique(doc * count + name), count)


def learn_lexicon(labelled: DataFrame, n_toxic: int, n_other: int) -> Lexicon:
    """Terms of the largest log-odds, at most TERMS of each sort."""
    if not n_toxic or not n_other:
        return Lexicon({}, {})
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    sure = F.col("odds") - ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    in_words = np.packbits(word_points())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, np.unpackbits(in_words).astype(bool))

    frequent = stored(
        labelled.mapInArrow(run, "term string, stem boolean, toxic long, other long")
        .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") >= max(5, SHARE * n_toxic)),
        "terms",
    ).withColumn("odds", odds)
    words = (
        frequent.where(~F.col("stem") & (sure >= LOG_ODDS))
        .orderBy(F.desc("toxic"), "term").limit(TERMS).collect()
    )
    # What a stem stands for, up to a point: a longer one is rarer, a shorter one less telling.
    gain = F.col("toxic") * F.least("odds", F.lit(LOG_ODDS))
    candidates = (
        frequent.where(F.col("stem") & (sure >= STEM_LOG_ODDS))
        .where(F.col("toxic") >= max(5, STEM_SHARE * n_toxic))
        .orderBy(F.desc(gain), F.length("term"), "term").limit(TERMS).collect()
    )
    stems: dict[str, float] = {}
    for r in candidates:
        related = any(r.term.startswith(s) or s.startswith(r.term) for s in stems)
        one_word = max((w.toxic for w in words if w.term.startswith(r.term)), default=0)
        if not related and one_word < 0.6 * r.toxic:
            stems[r.term] = r.odds
    words = {w.term: w.odds for w in words if not any(w.term.startswith(s) for s in stems)}
    return Lexicon(words, stems)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, automaton and weights from the bounded samples of labelled documents."""
    labelled = _labelled(docs, labels)
    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    automaton = machine(learn_lexicon(labelled, n_toxic, n_other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            toxic = batch.filter(pc.equal(batch.column(1), 1)).column(0)
            rows, marks = [figures(batch.column(0), automaton)], [batch.column(1).to_numpy()]
            weight = [np.ones(batch.num_rows)]
            for change, mark in COPIES:
                texts, changed = rewritten(toxic, automaton, change)
                rows.append(figures(texts, automaton)[changed])
                marks.append(np.full(changed.sum(), mark))
                weight.append(np.full(changed.sum(), COPY_WEIGHT))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(np.concatenate(rows)), pa.list_(pa.float64())),
                    pa.array(np.concatenate(marks).astype(np.int32)),
                    pa.array(np.concatenate(weight)),
                ],
                ["figures", "toxic", "weight"],
            )

    share = F.when(F.col("toxic") == 1, TOXIC / max(n_toxic, 1)).otherwise(OTHER / max(n_other, 1))
    # About TOXIC * (1 + len(COPIES)) + OTHER rows of figures, whatever the input.
    made = "figures array<double>, toxic int, weight double"
    rows = labelled.where(_place("text") < share).mapInArrow(run, made).collect()
    x = np.array([r.figures for r in rows]).reshape(len(rows), len(FIGURES))
    y, weight = np.array([r.toxic for r in rows], float), np.array([r.weight for r in rows], float)
    return Model(automaton, *_fitted(x, y, weight))


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, both classes weighing the same.

    Evidence whose weight would be negative, and quotation whose weight would be positive, is left out.
    """
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), (5.0 if len(y) and y[0] else -5.0)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    toxic = np.average(y, weights=weight)
    share = np.where(y == 1, 0.5 / toxic, 0.5 / (1 - toxic)) * weight * len(y) / 1000
    weights = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ weights, -30, 30)))
        gradient = x1.T @ (share * (p - y)) + penalty @ weights
        curve = (x1 * (share * p * (1 - p))[:, None]).T @ x1 + penalty + 1e-9 * np.eye(len(weights))
        move = np.linalg.solve(curve, gradient)
        weights -= move
        if np.abs(move).max() < 1e-8:
            break
    sign = np.where(np.arange(x.shape[1]) < EVIDENCE, 1, -1)
    against = np.flatnonzero(weights[:-1] * sign < -1e-6)
    if len(against):
        x = x.copy()
        x[:, against] = 0
        return _fitted(x, y, weight, ridge)
    return weights[:-1], float(weights[-1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(batch.column(1)))], ["doc_id", "score"]
            )

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, score double")


@registered()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
