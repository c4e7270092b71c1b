"""Language identification (1) and quality (4): held-out accuracy, documented cases, SQL."""

import random

import numpy as np
import pytest

from quillon.llm import lang_id, quality
from tests.llm.data import CLASH, docs, hard_rows, taken

ALPHABET = {"en": "etaoinshrdlu", "de": "enisratdhulcgz", "fr": "esaitnrulodcqé", "es": "eaosrnidlctuñ", "ru": "оеаинтсрвлкм"}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(ALPHABET[lang]) for _ in range(rng.randint(3, 9))) for _ in range(n))


def labelled(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, sentence(rng, lang, rng.choice([8, 30, 120])), lang, "web") for i, lang in enumerate(rng.choice(list(ALPHABET)) for _ in range(n))]


def test_held_out_accuracy(spark):
    model = lang_id.fit(docs(spark, labelled(1, 800)), 100)
    held = labelled(2, 300)
    out = lang_id.language_id(docs(spark, held), model=model).collect()
    right = sum(r.predicted == r.lang for r in out)
    assert right >= 0.95 * len(held)
    assert all(r.family == lang_id.family_of(r.predicted) for r in out)
    assert sum(r.accepted for r in out) >= 0.9 * len(held)


def test_steps_are_family_then_pairs():
    rng = random.Random(3)
    rows = [(sentence(rng, lang, 40), lang) for lang in ALPHABET for _ in range(20)]
    model = lang_id.Model(lang_id.frequencies([t for t, _ in rows]), [c for _, c in rows])
    assert [t for t in model.tasks if t[0] == "family"] == [("family", f, "") for f in ("germanic", "romance", "slavic")]
    assert [t for t in model.tasks if t[0] != "family"] == [("germanic", "de", "en"), ("romance", "es", "fr")]


def test_svm_separates_and_is_deterministic():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(200, 5)) + np.repeat([[2.0], [-2.0]], 100, 0), np.ones((200, 1))])
    y = np.repeat([1.0, -1.0], 100)
    rows = [(np.arange(6), v) for v in x]
    w = lang_id.train_svm(rows, y, 6)
    assert ((x @ w > 0) == (y > 0)).mean() > 0.99
    assert (w == lang_id.train_svm(rows, y, 6)).all()
    # no direction lowers the loss of the primal: it is solved
    loss = lambda v: 0.5 * v @ v + 10 * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    w = lang_id.train_svm(rows, y, 6, epochs=300)
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(size=(50, 6)) * 1e-2)


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "fr"], ["en", "de", "fr", "es", "ru"]])
def test_predictions_match_brute_force(spark, langs):
    rng = random.Random(8)
    known = [(sentence(rng, c, 30), c) for c in langs for _ in range(12)]
    model = lang_id.Model(lang_id.frequencies([t for t, _ in known]), [c for _, c in known])
    rows = [(i, sentence(rng, rng.choice(list(ALPHABET)), rng.choice([1, 5, 60])), None, "web") for i in range(60)] + [(100 + i, r[1]) for i, r in enumerate(hard_rows(rng)[:10])]
    for r in lang_id.language_id(docs(spark, rows), model=model).collect():
        family, lang, margin = lang_id.brute_force(model, next(x[1] for x in rows if x[0] == r.doc_id))
        assert (r.family, r.predicted) == (family, lang) and abs(r.margin - margin) < 1e-4
        assert r.accepted == (r.margin >= lang_id.MARGIN and r.margin > 0) or abs(margin - lang_id.MARGIN) < 1e-4


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "de"], ["en", "fr"]])
def test_few_languages(spark, langs):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang, 30), lang, "web") for i, lang in enumerate(langs * 20)]
    out = lang_id.language_id(docs(spark, rows + [(99, "abc", None, None)]))
    right = [r.predicted == r.lang for r in out.collect() if r.lang]
    assert sum(right) >= 0.9 * len(right)
    if not langs:
        assert [r.predicted for r in out.collect()] == ["und"]


def test_language_hard_rows(spark):
    rows = labelled(5, 200) + hard_rows(random.Random(1))
    for clash in (False, True):
        d = docs(spark, rows, clash)
        out = lang_id.language_id(d).collect()
        assert len(out) == len(rows)
        by = {r.doc_id: r for r in out[200:]}
        for i in (1, 2, 3, 9):
            assert by[i].predicted == by[i].family == "und" and by[i].margin == 0 and not by[i].accepted
        kept = lang_id.keep(d)
        assert kept.columns == d.columns
        accepted = sorted((r.doc_id or -1) for r in out if r.accepted)
        assert sorted((r.doc_id or -1) for r in kept.collect()) == accepted
    assert lang_id.language_id(docs(spark, [])).collect() == []
    assert lang_id.keep(docs(spark, [])).collect() == []


def test_whole_texts_count(spark):
    """A text that turns into another language after its first 100,000 characters is judged by all of it."""
    rng = random.Random(6)
    model = lang_id.fit(docs(spark, labelled(1, 400)), 60)
    text = sentence(rng, "en", 15_000) + " " + sentence(rng, "ru", 60_000)
    assert lang_id.language_id(docs(spark, [(1, text)]), model=model).first().predicted == "ru"


# --- quality --------------------------------------------------------------------------------------------------------


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def site_rows(n: int = 600, seed: int = 7) -> tuple[list, list]:
    """Good prose and junk; host 'bad' is junk throughout, 'rare' has two documents."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        host = rng.choice(["good", "good", "mixed", "bad"]) if i > 1 else "rare"
        good = rng.random() < {"good": 0.95, "mixed": 0.5, "bad": 0.05, "rare": 1.0}[host]
        text = sentence(rng, "en", rng.randint(20, 80)) + "." if good else " ".join("$$$ CLICK!!! 100%" for _ in range(rng.randint(5, 30)))
        rows.append((i, text, "en", f"https://{host}.org/{rng.choice('ab')}/x"))
        truth[i] = int(good)
    return rows, truth


def test_quality_held_out(spark):
    rows, truth = site_rows()
    known = [(i, truth[i], 0) for i in range(0, 600, 3)]
    out = quality.quality(docs(spark, rows), labels(spark, known)).collect()
    held = [r for r in out if r.doc_id % 3]
    assert sum(r.accepted == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    prior = {r.host: r.prior for r in out}
    assert prior["good.org"] > prior["mixed.org"] > prior["bad.org"]
    # two good documents don't make a site certain: it is shrunk towards the corpus
    assert prior["rare.org"] < 0.99
    assert {r.path for r in out if r.host == "good.org"} == {"good.org/a", "good.org/b"}


def test_sparse_paths_shrink_more(spark):
    rows, truth = site_rows(400)
    rows += [(1000, rows[5][1], "en", "https://good.org/new/1")]
    out = quality.quality(docs(spark, rows), labels(spark, [(i, truth[i], 0) for i in range(0, 400, 2)])).collect()
    by = {r.path: r.prior for r in out}
    assert abs(by["good.org/new"] - (by["good.org/a"] + by["good.org/b"]) / 2) < 0.25


def test_quality_hard_rows(spark):
    rows, truth = site_rows(200)
    rows += hard_rows(random.Random(1))
    known = [(i, truth[i], 0) for i in range(200)] + [(5, None, None), (None, 1, 0), (3, 1 - truth[3], 0), (3, 1 - truth[3], 0), (3, truth[3], 0)]
    for clash in (False, True):
        d = docs(spark, rows, clash)
        out = quality.quality(d, labels(spark, known)).collect()
        assert len(out) == len(rows)
        bad = [r for r in out if not (0 <= r.posterior <= 1 and 0 < r.prior < 1)]
        assert not bad
        kept = quality.keep(d, labels(spark, known))
        assert kept.columns == d.columns
        assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in out if r.accepted)
        if clash:
            assert {r._host for r in kept.collect()} == {CLASH.index("_host")}  # the table's own column is what it was
    assert quality.quality(docs(spark, []), labels(spark, known)).collect() == []
    assert quality.keep(docs(spark, []), labels(spark, [])).collect() == []


def test_null_and_empty_texts_have_no_features(spark):
    _, _, table = quality.fit(docs(spark, [(1, None), (2, ""), (3, "$$$ ABC")]), labels(spark, [(3, 1, 0)]))
    by = {r._id: r for r in table.collect()}
    assert all(by[i][f"_{k}"] == 0 for i in (1, 2) for k in quality.FEATURES) and by[1]._vocabulary == by[2]._vocabulary == 10
    assert by[3]._symbols == 20 and by[3]._capitals == 10 and by[3]._size == 1


def test_words_tell_what_counts_do_not(spark):
    """Good and bad texts of the same shape, told apart by their words alone; judged on labels that were held back."""
    rng = random.Random(9)
    pick = lambda k: " ".join(f"{'pq'[rng.random() < (0.7 if k else 0.3)]}{rng.randrange(100):03}" for _ in range(60))
    rows = [(i, pick(i % 3 == 0), "en", "web") for i in range(700)]
    out = quality.quality(docs(spark, rows), labels(spark, [(i, int(i % 3 == 0), 0) for i in range(0, 700, 2)])).collect()
    held = [r for r in out if r.doc_id % 2]
    assert sum(r.accepted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)


def test_no_labels(spark):
    out = quality.quality(docs(spark, site_rows(20)[0]), labels(spark, [])).collect()
    assert all(r.evidence == 0 and abs(r.prior - 0.5) < 0.1 for r in out)


def test_rows_are_the_same_in_any_order(spark):
    rows, truth = site_rows(100)
    known = labels(spark, [(i, truth[i], 0) for i in range(50)])
    a = taken(quality.quality(docs(spark, rows), known))
    assert a == taken(quality.quality(docs(spark, rows[::-1]).repartition(3), known))


def test_words_of_texts_leave_the_shared_folder(spark):
    from pathlib import Path

    from quillon.sources.workspace import shared_dir

    wide = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("quillon-tables-*/quality-*"))
    before = wide()
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality.quality(docs(spark, labelled(4, 40)), labels).count() == 40
    assert wide() == before
