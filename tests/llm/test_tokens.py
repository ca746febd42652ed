import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roiforge.llm import packing
from roiforge.llm.common import shared_folder, token_bytes, tokenizer_path, word_hashes
from roiforge.llm.orc_tokens import checksums, look_up, read_tokens, write_tokens

ODD = ["", None, "J̌ J̌. İ", "a\x0bb\x0cc\x1cd\x85e f", "don't 'tis it's... <|endoftext|> x", "★ a★b", "x.'s 12.3% a1!b2 ﬁ.", "日本語。 123abc!!", "same", "same", "word " * 3000]
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=60, deadline=None)
def test_cached_words_give_the_tokenizers_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for text, ids in zip(texts, token_bytes(texts, tokenizer_path()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.WordLevel({"A": 0, "a": 1, "b": 2, "?": 3}, unk_token="?"))
    t.normalizer, t.pre_tokenizer = normalizers.NFC(), pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "own.json")
    t.save(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in token_bytes(["A a b", None, "x A"], path)] == [[0, 1, 2], [], [3, 0]]


def test_orc_metadata_prunes(spark):
    """Stripes, row index and Bloom filter are there, and a look-up reads less than the file."""
    path = shared_folder(spark, "orc")
    rows = [(k * 2, " ".join(f"word{k * 31 % 977} other{j}" for j in range(30)), "") for k in range(6000)]
    write_tokens(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, stripe_mb=1, stride=1000)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [f.getPath() for f in place.getFileSystem(conf).listStatus(place) if f.getPath().getName().endswith(".orc") and f.getLen() > 1000]
    reader = jvm.org.apache.orc.OrcFile.createReader(files[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
    footer = reader.getFileTail().getFooter()
    kinds = {str(s.getKind()) for k in range(reader.getStripes().size()) for s in _streams(jvm, reader, k)}
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds) and footer.getNumberOfRows() > 0
    plan = look_up(spark, path, [8, 9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert [r["doc_id"] for r in look_up(spark, path, [8, 9]).collect()] == [8]


def _streams(jvm, reader, k):
    rows = reader.rows()
    footer = rows.readStripeFooter(reader.getStripes().get(k))
    found = [footer.getStreams(i) for i in range(footer.getStreamsCount())]
    rows.close()
    return found


def test_odd_texts(encoded):
    assert [np.frombuffer(x, "<u4").tolist() for x in token_bytes(ODD, tokenizer_path())] == [encoded(t) for t in ODD]


def test_word_hashes_know_words_apart():
    text = b"a b  ab\tA \n" + "éè".encode() + b" a" + b"x" * 300_000 + b" a"
    h, s, e = word_hashes(np.frombuffer(text, np.uint8))
    words = text.lower().split()
    assert [text[i:j].lower() for i, j in zip(s, e, strict=True)] == words
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    assert len(word_hashes(np.zeros(0, np.uint8))[0]) == 0


def test_orc_round_trip(spark, encoded):
    rows = [(3 * k + 5, t, "clash") for k, t in enumerate(ODD)]
    path = shared_folder(spark, "orc")
    write_tokens(spark.createDataFrame(rows, SCHEMA), path)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in checksums(read_tokens(spark, path)).collect()}
    start = 0
    for i, t, _ in rows:
        ids = np.array([*encoded(t), 1], "<u4")
        assert found[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert look_up(spark, path, [8]).first()["ids"] == [1]


def test_orc_nulls_repeats_and_no_rows(spark):
    path = shared_folder(spark, "orc")
    write_tokens(spark.createDataFrame([(None, "a", ""), (1, "b", ""), (1, "a", "")], SCHEMA), path)
    assert [(r["doc_id"], r["start"]) for r in read_tokens(spark, path).orderBy("start").collect()] == [(None, 0), (1, 2), (1, 4)]
    empty = shared_folder(spark, "orc")
    write_tokens(spark.createDataFrame([], SCHEMA), empty)
    assert checksums(read_tokens(spark, empty)).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=25))
@settings(max_examples=40, deadline=None)
def test_bins_hold_every_length_once(counts):
    plan = packing.complete_bins(counts, 60)
    used: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(pattern) <= 60 and times > 0
        for s in pattern:
            used[s] = used.get(s, 0) + times
    assert used == counts
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, 60))


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=25))
@settings(max_examples=300, deadline=None)
def test_best_fit_decreasing_piece_by_piece(counts):
    plan = packing.best_fit(counts, 60)
    rooms = sorted(60 - sum(p) for p, t in plan for _ in range(t))
    assert rooms == plain_best_fit([s for s, n in counts.items() for _ in range(n)], 60)


def test_completion_beats_best_fit():
    counts = {6: 1, 5: 1, 4: 1, 3: 3}  # 8 | 6 5 4 3 3 3: best fit leaves 6+3, but 6+4 5+5 ...
    optimal = packing.complete_bins(counts, 12)
    assert sum(t for _, t in optimal) == 2
    assert packing.complete_bins({}, 10) == []
    with pytest.raises(ValueError, match="length"):
        packing.complete_bins({11: 1}, 10)


def test_packing_texts(spark, encoded):
    rows = [(k, t, "") for k, t in enumerate(ODD)] + [(0, "again", ""), (None, "none", "")]
    pieces, placed = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=64)
    found = placed.collect()
    want = sorted((i if i is not None else -1, k) for i, t, _ in rows for k in range(-(-(len(encoded(t)) + 1) // 64)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"]) for r in found) == want
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in found:
        if r["doc_id"] not in (0, None):
            ids = np.array([*encoded(dict((k, t) for k, t, _ in rows)[r["doc_id"]]), 0], "<u4")
            assert r["start"] == 64 * r["piece"] and r["length"] == len(ids[r["start"] : r["start"] + 64])
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + 64].tobytes())
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    whole = packing.sequences(pieces, placed).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in found)
    assert packing.pack(spark.createDataFrame([], SCHEMA))[1].count() == 0
