"""Fingerprints (6), WARC (7), token store (9), license scan (10): brute force and round trips."""

import gzip
import io
import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import fingerprints, license_scan, queries, token_store, warc
from tests.llm.data import docs, hard_rows, taken, words

# --- fingerprints ---------------------------------------------------------------------------------------------------


@given(st.lists(st.text(alphabet="ab c", min_size=1, max_size=300), min_size=1, max_size=4), st.integers(0, 6))
@settings(max_examples=80, deadline=None)
def test_parse_matches_brute_force(texts, level):
    levels, root, names = fingerprints.parse(texts, level)
    for i, t in enumerate(texts):
        assert (levels[i], root[i], names[i].tolist()) == fingerprints.brute_force(t, level)


def test_shared_passages_share_signatures(spark):
    """Whatever surrounds it and at whatever offset: all but a few phrases at a passage's ends keep their names."""
    rng = random.Random(1)
    passage = words(rng, 400, 5000)
    rows = [(i, words(rng, rng.randint(0, 300), 5000) + " " + passage + " " + words(rng, rng.randint(0, 300), 5000)) for i in range(10)]
    own = set(fingerprints.fingerprints(docs(spark, [(0, passage)])).first().signatures)
    for r in fingerprints.fingerprints(docs(spark, rows)).collect():
        assert len(own & set(r.signatures)) >= 0.8 * len(own)
    other = set(fingerprints.fingerprints(docs(spark, [(0, words(rng, 400, 5000))])).first().signatures)
    assert len(own & other) <= 0.02 * len(own)


def test_short_passages_share_names_of_lower_levels(spark):
    """Passages of 15 to 60 words between different texts: where level 4 has no common name, a lower one has."""
    rng = random.Random(3)
    passages = [words(rng, 15 + i % 46, 5000) for i in range(92)]
    context = lambda: words(rng, rng.randint(20, 80), 5000)
    rows = [(i + 1000 * k, f"{context()} {p} {context()}") for i, p in enumerate(passages) for k in (0, 1)]
    by = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, rows)).collect()}
    common = lambda i, names: set(names(by[i])) & set(names(by[i + 1000]))
    assert not all(common(i, lambda r: r.signatures) for i in range(92))
    assert all(common(i, lambda r: r.lower[0]) and common(i, lambda r: r.lower[1]) for i in range(92))
    # and not by chance: texts without a common passage hardly share names of level 3
    assert sum(bool(set(by[i].lower[1]) & set(by[i + 1001].lower[1])) for i in range(91)) <= 9
    for i, text in rows[:20]:
        assert by[i].lower == [fingerprints.brute_force(text, k)[2] for k in (2, 3)]
    hard = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, [(1, None), (2, ""), (3, "a")])).collect()}
    assert hard[1].lower == hard[2].lower == [[], []] and hard[3].lower == [hard[3].signatures] * 2
    assert all(r.lower == [] for r in fingerprints.fingerprints(docs(spark, rows[:3]), 2).collect())


def test_roots_name_texts(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(1, 50)) for _ in range(200)]
    out = fingerprints.fingerprints(docs(spark, [(i, t) for i, t in enumerate(texts + texts)])).collect()
    by = {r.doc_id: (r.n_levels, r.root) for r in out}
    assert all(by[i] == by[i + 200] for i in range(200))
    assert len(set(by.values())) == len(set(texts))


def test_fingerprints_hard_rows(spark):
    rows = hard_rows(random.Random(1)) + [(40, "a" * 50_000), (41, "ab" * 20_000)]
    for clash in (False, True):
        out = fingerprints.fingerprints(docs(spark, rows, clash)).collect()
        assert len(out) == len(rows)
        by = {r.doc_id: r for r in out}
        assert (by[1].n_chars, by[1].n_levels, by[1].root, by[1].signatures) == (None, 0, None, [])
        assert (by[2].n_chars, by[2].n_levels, by[2].root, by[2].signatures) == (0, 0, None, [])
        assert by[40].n_levels == 1
        small = {r[0]: r[1] for r in rows if r[0] is not None and r[1] and len(r[1]) < 1000}
        for i, t in small.items():
            assert (by[i].n_levels, by[i].root, by[i].signatures) == fingerprints.brute_force(t, 4)
    assert fingerprints.fingerprints(docs(spark, [])).collect() == []


# --- WARC -----------------------------------------------------------------------------------------------------------


def run(data: bytes) -> tuple[list[dict], bytes]:
    out = io.BytesIO()
    return list(warc.normalise(io.BytesIO(data), out)), out.getvalue()


def test_every_record_is_a_member():
    rng = random.Random(1)
    records = [warc.warc_record(i, f"http://h/{i}", words(rng, rng.choice([0, 5, 3000]))) for i in range(60)]
    rows, data = run(gzip.compress(b"".join(records)))
    assert [r["record_no"] for r in rows] == list(range(60)) and {r["status"] for r in rows} == {"ok"}
    for r, whole in zip(rows, records):
        assert zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31) == whole
    assert rows[-1]["offset"] + rows[-1]["length"] == len(data)
    assert gzip.decompress(data) == b"".join(records)
    # what is normalised already stays what it is
    assert run(data) == (rows, data)


@given(st.binary(max_size=300), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_noise_never_crashes(noise, seed):
    rng = random.Random(seed)
    good = warc.warc_record(1, "http://a", "x" * rng.randint(0, 2000))
    whole = gzip.compress(noise.replace(b"WARC/", b"") + good)
    rows, data = run(whole)
    assert [r["status"] for r in rows] == ["ok"] and gzip.decompress(data) == good
    cut = whole[: rng.randint(0, len(whole) - 1)]
    rows, data = run(cut)
    assert all(r["status"] != "ok" or data for r in rows)
    run(noise)


def test_truncated_and_lengthless_records():
    a, b = warc.warc_record(1, "http://a", "aaa"), warc.warc_record(2, "http://b", "b" * 5000)
    rows, data = run(gzip.compress(a + b[:-100]))
    assert [r["status"] for r in rows] == ["ok", "truncated"] and rows[0]["length"] == rows[1]["offset"]
    assert gzip.decompress(data[: rows[0]["length"]]) == a and gzip.decompress(data[rows[1]["offset"] :]) == b[:-100]  # what there is of it is kept
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nsome: thing\r\n\r\n"
    rows, data = run(gzip.compress(info + a))
    assert [r["status"] for r in rows] == ["no length", "ok"] and gzip.decompress(data) == info + a
    rows, data = run(gzip.compress(a + info))
    assert [r["status"] for r in rows] == ["ok", "no length"] and gzip.decompress(data) == a + info
    # a record that nothing closes gets its line ends, one that follows at once is not eaten
    rows, data = run(gzip.compress(a[:-4] + b))
    assert [r["status"] for r in rows] == ["ok", "ok"] and gzip.decompress(data) == a + b


def brute_records(members: list[bytes]) -> list[bytes]:
    """The records of members that can be inflated, cut by their lengths."""
    out = []
    for m in members:
        data = gzip.decompress(m)
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length")))
            out.append(head + b"\r\n\r\n" + rest[: size + 4])
            data = rest[size + 4 :]
    return out


@pytest.mark.parametrize("garbage", [b"garbage", b"\x1f\x8b\x08 not a header", b"\0" * 600_000, os.urandom(700_000)])
def test_garbage_between_members_loses_no_record(garbage):
    rng = random.Random(4)
    members = [gzip.compress(b"".join(warc.warc_record(10 * k + i, f"http://h/{i}", words(rng, 40)) for i in range(10))) for k in range(3)]
    rows, data = run(garbage.join(members))
    ok = [r for r in rows if r["status"] == "ok"]
    assert [zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31) for r in ok] == brute_records(members)
    assert [r["status"] for r in rows if r["status"] != "ok"] == (["corrupt"] * 2 if garbage.strip(b"\0") else [])
    assert [r["record_no"] for r in rows] == list(range(len(rows)))


def test_a_broken_member_loses_only_what_it_holds_behind_the_break():
    rng = random.Random(5)
    members = [gzip.compress(b"".join(warc.warc_record(10 * k + i, f"http://h/{i}", words(rng, 400)) for i in range(10))) for k in range(3)]
    broken = bytearray(members[1])
    broken[len(broken) // 2 : len(broken) // 2 + 30] = b"\xff" * 30
    rows, data = run(members[0] + bytes(broken) + members[2])
    ok = {r["page_id"] for r in rows if r["status"] == "ok"}
    assert {*range(10), *range(20, 30)} <= ok and ok & set(range(10, 20))
    assert "corrupt" in [r["status"] for r in rows]
    last = [r for r in rows if r["page_id"] is not None and r["page_id"] >= 20]
    assert [zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31) for r in last] == brute_records([members[2]])


def test_large_records_and_long_garbage_take_little_memory():
    import tracemalloc

    big = b"x" * 200_000_000
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(big)
    raw = z.compress(b"-" * 100_000_000) + z.compress(head) + z.compress(big) + z.compress(b"\r\n\r\n" + warc.warc_record(7, "u", "h")) + z.flush()
    del big
    tracemalloc.start()
    out = io.BytesIO()
    rows = list(warc.normalise(io.BytesIO(raw), out))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["status"] for r in rows] == ["ok", "ok"] and rows[1]["page_id"] == 7 and peak < 60_000_000
    assert zlib.decompress(out.getvalue()[: rows[0]["length"]], 31).count(b"x") == 200_000_000
    assert [r["status"] for r in run(gzip.compress(b"WARC/1.0\r\n" + b"h" * 3_000_000 + warc.warc_record(8, "u", "h")))[0]] == ["bad header", "ok"]


def test_files_of_one_name_keep_apart(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "x.warc.gz").write_bytes(gzip.compress(b"".join(warc.warc_record(i, f"http://{k}/{i}", k * i) for i in range(5))))
    files = spark.createDataFrame([(f"file://{tmp_path}/{k}/x.warc.gz",) for k in "ab"], "file string")
    index = warc.normalise_files(files, f"file://{tmp_path}/out").collect()
    assert len({r.file for r in index}) == 2
    got = sorted(warc.read_record(r.file, r.offset, r.length) for r in index)
    assert got == sorted(warc.warc_record(i, f"http://{k}/{i}", k * i) for i in range(5) for k in "ab")


def pages(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("offset", F.lit("x"))


def test_pages_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", f"<p>{words(rng, 50)} é</p>") for i in range(200)] + [(None, "http://n", "x"), (201, None, "y"), (202, "http://e", None), (203, "http://f", ""), (5, "http://h/5", "again"), (204, "http://l", "z" * 3_000_000)]
    folder = f"file://{tmp_path}"
    files = [r[0] for r in warc.pages_to_warc(pages(spark, rows), f"{folder}/whole").collect()]
    index = warc.normalise_files(spark.createDataFrame([(f,) for f in [*files, files[0], None]], "file string"), f"{folder}/records").collect()
    got = sorted((warc.read_record(r.file, r.offset, r.length) for r in index))
    assert got == sorted(warc.warc_record(*r) for r in rows)
    assert {r.status for r in index} == {"ok"} and len(index) == len(rows)
    side = [line for f in {r.file for r in index} for line in open(f[7:] + ".idx")]
    assert len(side) == len(rows)
    out = warc.warc_normalise_pages(pages(spark, rows))
    assert sorted((r.page_id or -1, r.content_length) for r in out.collect()) == sorted((r.page_id or -1, r.content_length) for r in index)
    assert warc.warc_normalise_pages(pages(spark, [])).collect() == []


# --- token store ----------------------------------------------------------------------------------------------------

needs_tokenizer = pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no vocabulary file here")


def vocabulary() -> bytes:
    return token_store.read_vocabulary(queries.TOKENIZER)


@needs_tokenizer
def test_store_matches_brute_force(spark):
    """Every frame inflates, with the dictionary that its hash names, to the ids that the tokenizer gives its text."""
    import hashlib

    import zstandard

    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice([1, 40, 5000])), "en", rng.choice(["hot", "hot", "hot", "rare"])) for i in range(300)]
    store = token_store.token_store(docs(spark, rows), vocabulary())
    out = {r.doc_id: r for r in store.collect()}
    assert {r.dict_hash for r in out.values()} == {hashlib.sha256(store.dictionary).hexdigest()}
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(store.dictionary))
    for i, text, *_ in rows:
        assert press.decompress(out[i].frame) == token_store.encode(text, vocabulary()) and out[i].n_bytes == len(out[i].frame)
    offset: dict = {}
    for r in sorted(out.values(), key=lambda r: (r.shard, r.offset)):
        assert r.offset == offset.get(r.shard, 0)
        offset[r.shard] = r.offset + r.n_bytes


def test_training_pieces_come_from_everywhere(spark):
    rows = [(i, "h" * 100, "en", "hot") for i in range(400)] + [(1000, "a" * 8192 + "b" * 8192 + "c" * 100, "en", "rare"), (1001, None), (1002, "")]
    got = [r[0] for r in token_store.training_pieces(docs(spark, rows), 6).collect()]
    assert sorted(x[:1] for x in got) == ["a", "b", "c", "h", "h", "h"] and sorted(map(len, got))[-1] == 8192
    assert len(token_store.training_pieces(docs(spark, rows), 9999).collect()) == 403


@needs_tokenizer
def test_store_round_trip(spark, tmp_path):
    import numpy as np

    rng = random.Random(1)
    rows = [(i, words(rng, rng.choice([1, 10, 100]))) for i in range(400)] + hard_rows(rng)
    store = token_store.token_store(docs(spark, rows, clash=True), vocabulary())
    path = f"file://{tmp_path}/store"
    token_store.save(store, store.dictionary, path)
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) == len(rows) and len({r.dict_hash for r in index} - {""}) == 1
    texts: dict = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    enc = token_store.encoder(vocabulary(), token_store.PATTERN)
    for r in index:
        if r.n_bytes is None:
            assert r.n_tokens is None and None in texts[r.doc_id]
            continue
        ids = token_store.read_document(path, r.shard, r.offset, r.n_bytes)
        assert len(ids) == r.n_tokens
        assert enc.decode(ids) in texts[r.doc_id]
        assert ids == np.frombuffer(token_store.encode(enc.decode(ids), vocabulary()), "<u2").tolist()


@needs_tokenizer
def test_store_without_dictionary(spark):
    with pytest.warns(UserWarning, match="no dictionary"):
        out = token_store.token_store(docs(spark, [(1, "a"), (2, None), (3, "")]), vocabulary()).collect()
    by = {r.doc_id: r for r in out}
    assert {r.dict_hash for r in out} == {""} and by[2].frame is None and by[3].n_tokens == 0 and by[3].n_bytes > 0
    assert token_store.token_store(docs(spark, []), vocabulary()).collect() == []


@needs_tokenizer
def test_dictionary_helps_short_documents(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 30)) for i in range(600)]
    size = lambda d: sum(r.n_bytes for r in token_store.token_store(docs(spark, rows), vocabulary(), dictionary=d).select("n_bytes").collect())
    assert size(None) < 0.9 * size(b"")


# --- license scan ---------------------------------------------------------------------------------------------------


def mangled(rng, text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zzz"
    return " ".join(w)


def test_licenses_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 40))) for i in range(50)]
    for name, text in license_scan.TEMPLATES:
        i = len(rows)
        rows.append((i, text))
        rows.append((i + 1, words(rng, 30) + "\n" + text.upper() + "\n\n" + words(rng, 5)))
        rows.append((i + 2, words(rng, 300) + "\n\n" + text.replace(", ", ",\n") + "\n\n" + words(rng, 9)))
        rows.append((i + 3, mangled(rng, text, 1 + len(text.split()) // 20)))
        rows.append((i + 4, mangled(rng, text, len(text.split()) // 3)))
        rows.append((i + 5, words(rng, 9) + " " + text))
    got = taken(license_scan.license_scan(docs(spark, rows)))
    assert got == sorted(license_scan.brute_force(rows, license_scan.TEMPLATES), key=repr)
    found = {(i, n) for i, n, _ in got}
    assert all((50 + 6 * k + d, name) in found for k, (name, _) in enumerate(license_scan.TEMPLATES) for d in (0, 1, 2))
    assert all(i >= 50 for i, _, _ in got)


@pytest.mark.parametrize("t", [0.3, 1.0])
def test_license_thresholds(spark, t):
    rng = random.Random(2)
    templates = [("A", "one two three four"), ("B", "one two"), ("C", "x"), ("D", "")]
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "four", "five"]) for _ in range(rng.randint(0, 6)))) for i in range(200)]
    got = taken(license_scan.license_scan(docs(spark, rows), templates, t))
    assert got == sorted(license_scan.brute_force(rows, templates, t), key=repr)


def test_license_hard_rows(spark):
    mit = license_scan.TEMPLATES[0][1]
    rows = [r[:2] for r in hard_rows(random.Random(1))] + [(None, mit), (50, mit), (50, mit), (51, words(random.Random(3), 50_000) + "\n" + mit)]
    for clash in (False, True):
        got = taken(license_scan.license_scan(docs(spark, rows, clash)))
        assert got == sorted([(50, "MIT", 1.0), (50, "MIT", 1.0), (51, "MIT", 1.0), (None, "MIT", 1.0)], key=repr)
    assert taken(license_scan.license_scan(docs(spark, []))) == []
    assert taken(license_scan.license_scan(docs(spark, rows), [])) == []


@pytest.mark.parametrize("t", [0.3, 0.8, 1.0])
def test_license_runs_match_brute_force(spark, t):
    rng = random.Random(4)
    templates = [("A", "one two three four"), ("B", "one two"), ("B", "five one two five one"), ("C", "x"), ("D", ""), ("E", "two two two")]
    rows = [(i, rng.choice([" ", "\n", ". "]).join(rng.choice(["one", "two", "three", "four", "five"]) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    rows += [(200, "one two " * 40 + "three four"), (201, None), (202, ""), (None, "one two three four"), (203, "one"), (204, "two"), (205, "three four")]
    got = taken(license_scan.license_runs(docs(spark, rows), templates, t))
    assert got == sorted(license_scan.brute_force_runs(rows, templates, t), key=repr)
    assert taken(license_scan.license_runs(docs(spark, []))) == taken(license_scan.license_runs(docs(spark, rows), [])) == []


def test_license_runs_find_notices_anywhere(spark):
    """Every template on a line with prose and in pieces between blank lines, inside a long text; whatever the scan of fixed passages finds is found."""
    rng = random.Random(5)
    rows = []
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        rows.append((2 * k, words(rng, 300) + " " + text + " " + words(rng, 300)))
        rows.append((2 * k + 1, words(rng, 50) + "\n\n" + text.replace(". ", ".\n\n").replace(", ", ",\n") + "\n\n" + words(rng, 50)))
    rows.append((100, "Some closing remarks of the author about the text above. Licensed under CC BY 4.0."))
    got = {(i, n): d for i, n, d in taken(license_scan.license_runs(docs(spark, rows)))}
    assert all(got[2 * k + d, n] == 1.0 for k, (n, _) in enumerate(license_scan.TEMPLATES) for d in (0, 1)) and got[100, "CC-BY-4.0"] == 1.0
    before = taken(license_scan.license_scan(docs(spark, rows)))
    assert all(got[i, n] >= d for i, n, d in before) and len(before) < len(got)
