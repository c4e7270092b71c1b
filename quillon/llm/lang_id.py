"""Language identification in two steps: the language family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import chunks, lean, to_batch

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
#: Buckets of hashed character trigrams; labelled documents of a language that the training uses at most; least margin of an accepted text.
BUCKETS, TRAIN_DOCS, MARGIN = 8192, 600, 0.02
UNKNOWN = "und"


def family_of(lang: str) -> str:
    """A language that no family names is one of its own."""
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character trigrams of the lower-cased texts, and the text of each. What is no letter counts as a space; trigrams with a space in their middle are left out."""
    from quillon.llm.words import word_table

    low = [f" {t.lower()} " if t else "" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    doc = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    letter = word_table("unicode")[codes] & ~((codes >= 48) & (codes < 58))
    c = np.where(letter, codes, np.uint32(32))
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ok = letter[1:-1] & (doc[:-2] == doc[2:])
    return (h[ok] >> np.uint32(19)).astype(np.int64), doc[1:-1][ok]


def frequencies(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and their frequencies; none for a text without letters."""
    out = []
    for t in texts:
        bucket, count = np.unique(trigrams([t])[0], return_counts=True)
        out.append((bucket.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
    return out


def train_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int = BUCKETS + 1, cost: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent over sparse rows (places, values) of n columns. y: +1, -1. Classes weigh alike."""
    rng = np.random.default_rng(0)
    n_pos = max(1, (y > 0).sum())
    upper = cost * np.where(y > 0, len(y) / (2 * n_pos), len(y) / (2 * max(1, len(y) - n_pos)))
    diag, norm = 1 / (2 * upper), np.array([float(v @ v) for _, v in x])
    w, a = np.zeros(n), np.zeros(len(y))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, value = x[i]
            g = y[i] * float(value @ w[at]) - 1 + diag[i] * a[i]
            new = max(0.0, a[i] - g / (norm[i] + diag[i]))
            if new != a[i]:
                w[at] += (new - a[i]) * y[i] * value
                a[i] = new
    return w


class Model:
    """Machines as columns of `weights` (BUCKETS rows) with `bias`: one a family against the rest, then one a pair of languages of a family. Trained on rows of frequencies()."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        present = sorted(set(langs))
        self.families = sorted({family_of(c) for c in present})
        self.members = {f: [c for c in present if family_of(c) == f] for f in self.families}
        self.scale = float(1 / max(1e-9, np.mean([np.sqrt(float(v @ v)) for _, v in rows]))) if rows else 1.0
        x = [(np.append(at, BUCKETS), np.append(value * self.scale, 1.0)) for at, value in rows]
        self.tasks, columns = [], []
        # of two families one machine says all
        for f in self.families if len(self.families) > 2 else self.families[:1] if len(self.families) == 2 else []:
            self.tasks.append(("family", f, ""))
            columns.append(train_svm(x, np.array([1.0 if family_of(c) == f else -1.0 for c in langs])))
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                own = [i for i, c in enumerate(langs) if c in (a, b)]
                self.tasks.append((f, a, b))
                columns.append(train_svm([x[i] for i in own], np.array([1.0 if langs[i] == a else -1.0 for i in own])))
        full = np.stack(columns, 1) if columns else np.zeros((BUCKETS + 1, 0))
        self.weights, self.bias = np.ascontiguousarray((full[:-1] * self.scale).T.astype(np.float32)), full[-1]

    def predict(self, texts: list) -> tuple[list, list, np.ndarray]:
        """Family, language and margin of each text. The margin is the least of the deciding machines' margins; 0 for a text without letters."""
        h, doc = trigrams(texts)
        n = np.bincount(doc, minlength=len(texts))
        score = np.stack([np.bincount(doc, weights=w[h], minlength=len(texts)) / np.maximum(n, 1) for w in self.weights], 1) + self.bias if len(self.weights) else np.zeros((len(texts), 0))
        by_family = [i for i, t in enumerate(self.tasks) if t[0] == "family"]
        if not self.families:
            return [UNKNOWN] * len(texts), [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(by_family) == 1:
            s = score[:, by_family[0]]
            choice, margin = np.where(s >= 0, 0, 1), np.abs(s)
        elif by_family:
            s = score[:, by_family]
            choice, top = s.argmax(1), np.sort(s, 1)
            margin = top[:, -1] - top[:, -2]
        else:
            choice, margin = np.zeros(len(texts), int), np.full(len(texts), np.inf)
        langs = np.full(len(texts), UNKNOWN, object)
        for k, f in enumerate(self.families):
            rows, members = np.flatnonzero(choice == k), self.members[f]
            votes, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
            for i, (task, a, b) in enumerate(self.tasks):
                if task == f:
                    s = score[rows, i]
                    for c, sign in ((members.index(a), 1), (members.index(b), -1)):
                        won = s * sign > 0 if sign < 0 else s >= 0
                        votes[:, c] += won
                        least[:, c] = np.minimum(least[:, c], np.where(won, np.abs(s), np.inf))
            if len(rows):
                best = votes.argmax(1)
                langs[rows] = np.array(members, object)[best]
                margin[rows] = np.minimum(margin[rows], least[np.arange(len(rows)), best])
        margin = np.where(np.isinf(margin), 1.0, margin)
        none = n == 0
        margin[none] = 0
        families = np.array(self.families, object)[choice]
        families[none], langs[none] = UNKNOWN, UNKNOWN
        return families.tolist(), langs.tolist(), margin


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Trained on the driver on `train_docs` documents a language at most, those whose ids hash lowest among documents that name a language.

    Their texts stay on the executors: BUCKETS frequencies a document at most come to the driver, however long it is.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.col("lang").cast("string"), "text")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = named.select("doc_id", "lang").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= train_docs).select("doc_id", "lang").distinct()
    chosen = named.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("text", "lang")  # broadcast: train_docs ids a language

    def run(batches):
        for batch in batches:
            for a, b in chunks(texts := batch.column(0).to_pylist()):
                rows = frequencies(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *(pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in (0, 1))], names=["lang", "buckets", "values"])

    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in chosen.mapInArrow(lean(run), "lang string, buckets binary, values binary").collect())
    return Model([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for _, a, b in rows], [c for c, _, _ in rows])


def language_id(docs: DataFrame, train_docs: int = TRAIN_DOCS, margin: float = MARGIN, model: Model | None = None) -> DataFrame:
    """One row a document: (doc_id, lang, family, predicted, margin to 6 places, accepted); accepted: margin >= `margin`.

    Whole texts of any length count, by all their trigrams; training too counts its documents whole. A tie between the
    languages of a family, or between families, goes to the first by name. Null and empty texts and texts without letters are "und" with margin 0 and
    not accepted; a text of one word may be. A null language is not trained on, but predicted. Null ids and repeated rows keep a row each; extra
    columns are ignored. An empty table, or one that names no language, makes everything "und". One pass, no shuffle but
    that of the training ids; the machines (BUCKETS numbers each) travel with the task.
    """
    model = fit(docs, train_docs) if model is None else model
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("family", pa.string()), ("predicted", pa.string()), ("margin", pa.float64()), ("accepted", pa.bool_())])

    def run(batches):
        for batch in batches:
            ids, langs, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in chunks(texts):
                family, lang, m = model.predict(texts[a:b])
                yield to_batch(out, doc_id=ids[a:b], lang=langs[a:b], family=family, predicted=lang, margin=np.round(m, 6), accepted=(m >= margin) & (m > 0))

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(lean(run), "doc_id long, lang string, family string, predicted string, margin double, accepted boolean")


def keep(docs: DataFrame, train_docs: int = TRAIN_DOCS, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, all columns as they were, that language_id() accepts. Row by row: ids play no part in it."""
    model, place = fit(docs, train_docs), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in chunks(texts):
                m = model.predict(texts[a:b])[2]
                yield batch.slice(a, b - a).filter(pa.array((m >= margin) & (m > 0)))

    return docs.mapInArrow(lean(run), docs.schema)


def brute_force(model: Model, text: str | None) -> tuple[str, str, float]:
    """Family, language and margin of one text, machine by machine in plain Python."""
    low = f" {text.lower()} " if text else ""
    letter = lambda c: unicodedata.category(c)[0] in "LMN" and c not in "0123456789"
    low = "".join(c if letter(c) else " " for c in low)
    m, counts, total = (1 << 32) - 1, {}, 0
    for a, b, c in zip(low, low[1:], low[2:]):
        if b != " ":
            h = (ord(a) * 0x9E3779B1 & m) ^ (ord(b) * 0x85EBCA77 & m) ^ (ord(c) * 0xC2B2AE3D & m)
            h = (h ^ h >> 15) * 0x2C1B3C6D & m
            counts[h >> 19], total = counts.get(h >> 19, 0) + 1, total + 1
    if not total or not model.families:
        return UNKNOWN, UNKNOWN, 0.0
    score = {t: sum(float(w[b]) * n for b, n in counts.items()) / total + float(bias) for t, w, bias in zip(model.tasks, model.weights, model.bias)}
    ranked = sorted(((score["family", f, ""], f) for f in model.families if ("family", f, "") in score), key=lambda p: (-p[0], p[1]))
    if len(model.families) == 2:
        family, margin = model.families[0 if ranked[0][0] >= 0 else 1], abs(ranked[0][0])
    elif len(ranked) > 1:
        family, margin = ranked[0][1], ranked[0][0] - ranked[1][0]
    else:
        family, margin = model.families[0], float("inf")
    votes, least = {c: 0 for c in model.members[family]}, {c: float("inf") for c in model.members[family]}
    for (f, a, b), s in score.items():
        if f == family:
            winner = a if s >= 0 else b
            votes[winner] += 1
            least[winner] = min(least[winner], abs(s))
    best = min(votes, key=lambda c: (-votes[c], c))
    margin = min(margin, least[best])
    return family, best, 1.0 if margin == float("inf") else margin
