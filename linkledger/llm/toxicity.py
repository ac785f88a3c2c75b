"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses; the words of a clause are read as symbols (insult, threat, target,
negation, report, other), then the clause's end. Five small transducers are composed into one: the
insult one marks a clause with insults, the threat one a threat that a target follows, the target one
lets insults through only where the clause has a target (a person, a determiner or a copula that the
insult can refer to), the negation one tells negated insults and threats, and the report one
those of reported speech. A clause that the composed transducer accepts is a match of one of four
classes and adds the weights of its insult and threat words, times the factors of its path; a logistic
function of the document's sums is the score. Words count only as part of a matched clause: an insult in a
clause without a target, and a threat without one, add nothing.

What is learned, on at most SAMPLE labelled documents that are not held out (least hash of doc_id first):
the insult stems with their weights (log odds of the documents that hold a word with this stem: its first
three to eight letters, or the whole word), and the five numbers of the logistic function, which a ridge
draws to PRIOR. A class of match that the labelled rows hardly have thus keeps its prior number. The
function words below are fixed.

Defined cases: null and empty texts have no match and get the score of a text without matches. Rows with a
null doc_id are scored, not learned from; of rows that repeat a doc_id, each is scored and one is learned
from. Without labels of both kinds the fixed insults and PRIOR are used. An empty table gives no rows. Columns
of any name are kept as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, h64
from .units import let_go

SAMPLE = 20_000
#: Words whose symbols a Python worker keeps, and stems that it counts before it passes them on.
KNOWN, COUNTED = 100_000, 100_000
#: Toxic rows that hold a stem, at least.
LEAST_ROWS = 3
LEAST_G2, LEAST_PRECISION = 24.0, 0.8

# Words of the grammar in English, German, French and Spanish.
INSULTS = "idiot moron stupid pathetic worthless loser scum trash disgusting clown".split()
THREATS = "kill hurt beat destroy burn punish crush stab shoot töten schlagen verletzen tuer frapper détruire matar golpear destruir".split()
PERSONS = "i me we us you your yours he him his she her it its they them their du dich dir ihr euch sie er es wir ich je tu te toi nous vous il elle ils elles on yo tú ti nosotros usted ustedes él ella ellos ellas".split()
DETERMINERS = "the a an this that these those der die das den dem des ein eine einen le la les un une des du ce cet cette ces el los las una unos este esta ese esa".split()
COPULAS = "is are was were am be been ist sind war bist bin est sont était es son era eres".split()
NEGATIONS = "not never isn wasn aren don doesn nicht kein keine nie jamais pas nunca jamás".split()
REPORTS = "said says say told called claimed claims wrote quoted sagte schrieb dit disait dijo dice".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: What stands for a clause's end behind a transducer: insults alone, then the four classes of match.
ABUSE, AIMED, NEGATED, REPORTED, MENACE = range(7, 12)
CLASSES = (AIMED, NEGATED, REPORTED, MENACE)
#: Numbers of the logistic function before any row is seen: its constant, and one for each class.
PRIOR = np.array([-3.0, 3.0, 0.3, 0.8, 6.0])

TOKEN = re.compile(r"\w+|[.!?;\n]")
BREAKS = frozenset(".!?;\n")


class Transducer:
    """arcs[state][symbol] = (next state, symbol put out, factor). A symbol without an arc passes and the state stays, but
    any end of the clause leads back to state 0."""

    def __init__(self, arcs: list[dict[int, tuple[int, int, float]]]):
        self.arcs = arcs

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs[state].get(symbol, (0 if symbol >= END else state, symbol, 1.0))

    def compose(self, other: "Transducer", symbols: range) -> "Transducer":
        """Reads what self reads and puts out what other makes of it; factors multiply."""
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        for a, b in todo:
            row = {}
            for s in symbols:
                a2, mid, w1 = self.step(a, s)
                b2, out, w2 = other.step(b, mid)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                row[s] = (number[a2, b2], out, w1 * w2)
            arcs.append(row)
        return Transducer(arcs)


def grammar() -> Transducer:
    # The first insult of a clause counts in full, further ones by half.
    insult = Transducer([{INSULT: (1, INSULT, 1.0)}, {INSULT: (1, INSULT, 0.5), END: (0, ABUSE, 1.0)}])
    # A threat counts when a target follows within three words.
    after = [{THREAT: (1, THREAT, 1.0), TARGET: (4, TARGET, 1.0)} | {s: ((i + 1) % 4, s, 1.0) for s in (OTHER, INSULT, NEGATION, REPORT)} for i in (1, 2, 3)]
    threat = Transducer([{THREAT: (1, THREAT, 1.0)}, *after, {END: (0, MENACE, 1.0), ABUSE: (0, MENACE, 1.25)}])
    # Insults need a target in the clause.
    target = Transducer([{TARGET: (1, TARGET, 1.0), ABUSE: (0, END, 1.0)}, {ABUSE: (0, AIMED, 1.0)}])
    # A negation holds for the three words that follow it. One insult or threat elsewhere undoes it. States: words since the
    # negation (0: none holds), and 4 more when a negated insult or threat was read; last, when another one was read.
    held = []
    for seen in (0, 4):
        end = {s: (0, NEGATED, 0.5) for s in (AIMED, MENACE)} if seen else {}
        for since in range(4):
            on = (since + 1) % 4 if since else 0
            arcs = {NEGATION: (seen + 1, NEGATION, 1.0)} | {s: (seen + on, s, 1.0) for s in (OTHER, TARGET, REPORT)}
            held.append(arcs | {s: (4 + on if since else 8, s, 1.0) for s in (INSULT, THREAT)} | end)
    negation = Transducer([*held, {}])
    # Reported speech holds for the clause.
    report = Transducer([{REPORT: (1, REPORT, 1.0)}, {AIMED: (0, REPORTED, 0.5), MENACE: (0, REPORTED, 0.5)}])
    whole = insult
    for t in (threat, target, negation, report):
        whole = whole.compose(t, range(7))
    return whole


FIXED = {w: (s, 1.0) for s, ws in ((TARGET, PERSONS + DETERMINERS + COPULAS), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}


class Model:
    """Stems with weights, and the logistic function."""

    def __init__(self, stems: dict[str, float], weights: np.ndarray = PRIOR):
        self.stems, self.weights = stems, weights
        self.sizes = sorted({len(s) for s in stems if s[-1] != "$"}, reverse=True)
        self.machine, self.known = grammar(), {}

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            w = self.stems.get(word + "$") or next((self.stems[word[:k]] for k in self.sizes if word[:k] in self.stems), None)
            found = (INSULT, w) if w else FIXED.get(word, (OTHER, 1.0))
            if len(word) > 40:
                return found
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[word] = found
        return found

    def clauses(self, text: str | None):
        """(class, weight) of each matched clause."""
        words = TOKEN.findall((text or "").lower())
        symbol = self.symbol
        symbols = [None if w in BREAKS else symbol(w) for w in words]
        done = -1
        for i in [i for i, s in enumerate(symbols) if s is not None and (s[0] == INSULT or s[0] == THREAT)]:
            if i < done:
                continue
            a = i
            while a and symbols[a - 1] is not None:
                a -= 1
            state, done, total = 0, a, 0.0
            while done < len(symbols) and symbols[done] is not None:
                s, w = symbols[done]
                state, _, factor = self.machine.step(state, s)
                if s == INSULT or s == THREAT:
                    total += w * factor
                done += 1
            _, put, factor = self.machine.step(state, END)
            if put != END:
                yield put, total * factor

    def matches(self, text: str | None) -> np.ndarray:
        """A leading 1, then log(1 + summed weights) of the matches of each class."""
        out = np.zeros(1 + len(CLASSES))
        for kind, w in self.clauses(text):
            out[1 + CLASSES.index(kind)] += w
        out[1:] = np.log1p(out[1:])
        out[0] = 1
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.matches(text) @ self.weights))))))


def stems_of(text: str | None) -> set[str]:
    """Prefixes of three to eight letters of the words, and whole words (with a closing $)."""
    out = set()
    for w in set(TOKEN.findall((text or "").lower())):
        if w not in BREAKS:
            out.add(w + "$")
            out.update(w[:k] for k in range(3, min(8, len(w)) + 1))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def telling(toxic: int, clean: int) -> Column:
    """Whether the counts t and c of a stem come up to LEAST_G2 and LEAST_PRECISION (a little less, for rounding)."""
    base, p = toxic / (toxic + clean), F.col("t") / (F.col("t") + F.col("c"))
    g = 2 * (F.col("t") * F.log(p / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - p) / (1 - base))).otherwise(0.0))
    return (g >= LEAST_G2 - 1e-6) & (p >= LEAST_PRECISION - 1e-9)


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems that tell the classes apart: by falling likelihood ratio, none that extends or shortens one before it."""
    found = []
    base = toxic / (toxic + clean)
    for s, (t, c) in counts.items():
        n, p = t + c, t / (t + c)
        g = 2 * (t * math.log(p / base) + (c * math.log((1 - p) / (1 - base)) if c else 0))
        if g >= LEAST_G2 and p >= LEAST_PRECISION:
            found.append((-g, -len(s.rstrip("$")), s, math.log((t + 0.5) / (toxic + 1) * (clean + 1) / (c + 0.5))))
    taken: dict[str, float] = {}
    parts: set[str] = set()
    for _, _, s, w in sorted(found):
        bare = s.rstrip("$")
        if bare in parts or any(bare[:k] in taken for k in range(3, len(bare) + 1)):
            continue
        taken[s] = w
        parts.update(bare[:k] for k in range(3, len(bare) + 1))
    return taken


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = 0.5) -> np.ndarray:
    w = prior.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    start = Model({w + "$": 6.0 for w in INSULTS})
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(h64(F.col("doc_id")), "doc_id").limit(sample)
    # At most `sample` rows of two numbers are broadcast; of rows that repeat a doc_id one is learned from.
    rows = docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text"), h64(F.col("text"))).alias("one"), F.max("toxic").alias("toxic"))
    rows = rows.select("one.text", F.col("toxic").cast("int").alias("toxic")).persist()
    try:
        sizes = dict(rows.groupBy("toxic").count().collect())
        if not sizes.get(0) or not sizes.get(1):
            return start

        def count(batches):
            for batch in batches:
                c = Counter(), Counter()
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    c[toxic == 1].update(stems_of(text))
                    if len(c[0]) + len(c[1]) > COUNTED:
                        yield counted(c)
                        c = Counter(), Counter()
                yield counted(c)

        def counted(c):
            clean, toxic = c
            n = [pa.array([*toxic.values(), *[0] * len(clean)], pa.int64()), pa.array([*[0] * len(toxic), *clean.values()], pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([*toxic, *clean], pa.string()), *n], ["stem", "t", "c"])

        seeds = [w + "$" for w in INSULTS]
        n = rows.where("toxic in (0, 1)").mapInArrow(count, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        # Only stems that tell the classes apart come to the driver; choose() tests them again.
        n = n.where(F.col("t") >= LEAST_ROWS).where(telling(sizes[1], sizes[0]) | F.col("stem").isin(seeds))
        counts = {r["stem"]: (r["t"], r["c"]) for r in n.collect()}
        stems = choose(counts, sizes[1], sizes[0])
        covered = {s.rstrip("$")[:k] for s in stems for k in range(3, 9)}
        fixed = {w: 6.0 for w in seeds if w[:-1][:8] not in covered and int.__ge__(*counts.get(w, (0, 0)))}
        model = Model(stems | fixed)

        def features(batches):
            for batch in batches:
                rows_ = [[*map(float, model.matches(t)), float(y)] for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                cols = np.array(rows_, np.float64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f"x{i}" for i in range(6)])

        # At most `sample` rows of six numbers come to the driver.
        x = rows.where("toxic in (0, 1)").select("text", "toxic").mapInArrow(features, ", ".join(f"x{i} double" for i in range(6))).toPandas().to_numpy()
        model.weights = fit_logistic(x[:, :5], x[:, 5])
        return model
    finally:
        rows.unpersist()


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the column `name`."""
    text = docs.columns.index("text")

    def run(batches):
        let_go()
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                found = pa.array([model.score(x.as_py()) for x in part.column(text)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op3_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all columns as they are."""
    name = free_name(docs, "score")
    return scored(docs, train(docs.select("doc_id", "text"), labels), name).where(F.col(name) < threshold).drop(name)
