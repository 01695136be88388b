import random
import zlib

import numpy as np
import pytest
from fixtures_llm import TEXTS, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactframe.llm import editcount, packing
from pactframe.llm.tokens import WordIds, tokenizer_path, word_ids

TOKENIZER = Tokenizer.from_file(tokenizer_path())
IDS = WordIds(tokenizer_path())


def encoded(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAzZ09 '’sStT\n\t\x1c\x00́éÉßİΣς中🙂​<|>endoftext.,_ǅ\x85\xa0ﬁ²Ⅷ"), max_size=40))
def test_cached_ids_are_the_tokenizers(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == encoded(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_fill_is_a_gapless_packing(lengths):
    sequence, offset = packing.fill(np.array(lengths, np.int64), 50)
    for s in set(sequence.tolist()):
        inside = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if sequence[i] == s)
        at = 0
        for o, n in inside:
            assert o == at
            at += n
        assert at <= 50
    assert len(set(sequence.tolist())) <= 2 * -(-sum(lengths) // 50) + 1


def test_two_pieces_replace_the_smallest():
    # Greedy leaves 60+30 (gap 10); 22 and 18 fill the widened gap of 40 exactly.
    sequence, _ = packing.fill(np.array([60, 30, 22, 18]), 100)
    assert sequence[0] == sequence[2] == sequence[3] != sequence[1]


def test_fill_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        packing.fill(np.array([0, 5]), 10)
    with pytest.raises(ValueError):
        packing.fill(np.array([11]), 10)


def test_packed_documents_round_trip(spark):
    rows = packing.pack_documents(odd(spark), extra={"ids_crc32": F.crc32("ids")}).collect()
    want = []
    for i, t in TEXTS:
        ids = [*encoded(t), 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((str(i), n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    check_sequences(rows)


def check_sequences(rows, capacity=4096):
    inside = {}
    for r in rows:
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in inside.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    return len(inside)


def test_packing_is_close_to_the_least_number_of_sequences(spark):
    rng = random.Random(4)
    lengths = [(min(4096, int(rng.lognormvariate(6, 1.2)) + 1),) for _ in range(20_000)]
    rows = packing.best_two_fit(spark.createDataFrame(lengths, "length long"), group_pieces=5_000).collect()
    assert check_sequences(rows) <= 1.002 * sum(n for n, in lengths) / 4096 + 4


def test_empty_packing(spark):
    assert packing.pack_documents(odd(spark, empty=True)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab c\n"), max_size=60), st.integers(1, 8),
       st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30), st.text(st.sampled_from("xy z\n'"), max_size=20)), max_size=8))
def test_counts_follow_any_edits(text, repeat, edits):
    text *= repeat * 20
    count = lambda t: len(IDS(t)) // 4
    tree = editcount.CountTree(text, None, count)
    for start, length, insert in edits:
        start, length = start * repeat, length * repeat
        tree.edit(start, length, insert)
        start = min(start, len(text))
        text = text[:start] + insert + text[start + length:]
        assert tree.chars[1] == len(text) and tree.tokens[1] == count(text)
    state = tree.state()
    assert state[0] == text
    again = editcount.tree_of(*state, count)
    again.edit(len(text) // 2, 1, "new word")
    assert again.tokens[1] == count(text[:len(text) // 2] + "new word" + text[len(text) // 2 + 1:])


def test_edited_counts_of_odd_rows(spark):
    docs = odd(spark)
    edits = spark.createDataFrame(
        [(9, 1, 5, 3, "abc"), (9, 2, 10**9, 5, " end"), (9, 3, None, None, None), (5, 1, 0, 3, ""), (1, 1, 0, 0, "hello there"), (99, 1, 0, 0, "no such document"),
         (13, 1, 0, 8, "again"), (None, 1, 0, 0, "x")], "doc_id long, seq long, start long, length long, insert string")
    out = editcount.apply_edits(editcount.index(docs), edits).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r.n_tokens == len(encoded(r.text)) == sum(r.leaf_tokens)
    long = next(r for r in out if r.doc_id == 9)
    assert long.n_edits == 3 and long.text.endswith(" end") and long.encoded_chars < len(long.text) / 50
    assert next(r for r in out if r.doc_id == 1).text == "hello there" and next(r for r in out if r.doc_id == 5).n_tokens == 0
    assert sorted(r.n_edits for r in out if r.doc_id == 13) == [0, 1]
    empty = odd(spark, empty=True)
    assert editcount.apply_edits(editcount.index(empty), edits).count() == 0


def test_derived_edits_keep_exact_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = editcount.apply_edits(editcount.index(docs), editcount.edits_of(docs)).collect()
    assert len(rows) == docs.count() and all(r.n_edits == 3 and r.n_tokens == len(encoded(r.text)) for r in rows)
    assert word_ids(tokenizer_path()) is word_ids(tokenizer_path())


def test_workers_keep_no_ids_after_a_task(spark):
    """Workers wait beside the executor: what a task cached must not stay charged to its memory."""
    docs = spark.range(0, 64, 1, 8).selectExpr("id AS doc_id", "concat('word', id, ' and some more of text ', id) AS text")
    assert packing.token_pieces(docs).count() == 64

    def held(batches):
        import sys

        import pyarrow as pa

        kept = getattr(sys.modules.get("_pactframe_llm_cache"), "kept", {})
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(v.runs) + len(v.words) for v in kept.values() if hasattr(v, "runs"))])], ["n"])

    assert [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()] == [0] * 8
