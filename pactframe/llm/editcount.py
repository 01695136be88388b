"""Token counts that follow edits: a segment tree of pre-token runs per document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .tokens import tokenizer_path, word_ids

#: Characters a leaf gathers before it ends at the next white space, and the
#: growth after which a tree is cut anew.
LEAF_CHARS, MOST_CHARS = 400, 4_000
#: A leaf may only end where the tokenizer splits anyway: after plain white space.
_LEAF = re.compile(r"[\s\S]{%d}[\s\S]*?[ \t\n\r](?![ \t\n\r])|[\s\S]+" % LEAF_CHARS)
_SPACE = " \t\n\r"
BATCH_CHARS = 4 << 20


class CountTree:
    """Leaves of whole pre-tokens with the sums of characters and tokens above them."""

    def __init__(self, text: str, tokens: list[int] | None, count: Callable[[str], int]) -> None:
        self.count = count
        self.encoded = 0
        self.build(text, tokens)

    def build(self, text: str, tokens: list[int] | None = None) -> None:
        leaves = _LEAF.findall(text)
        self.restore(leaves, tokens if tokens is not None else [self.encode(leaf) for leaf in leaves])

    def encode(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the character's place in it."""
        i = 1
        while i < self.size:
            i *= 2
            if place >= self.chars[i]:
                place -= self.chars[i]
                i += 1
        return i - self.size, place

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.size
        more, longer = tokens - self.tokens[i], len(text) - self.chars[i]
        while i:
            self.tokens[i] += more
            self.chars[i] += longer
            i //= 2

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start``; places past the end mean the end."""
        whole = self.chars[1]
        start = min(max(start, 0), whole)
        end = min(start + max(length, 0), whole)
        if not whole:
            self.build(insert)
            return
        first, a = self.find(start) if start < whole else self.last()
        last, b = self.find(end) if end < whole else self.last()
        text = self.leaves[first][:a] + insert + self.leaves[last][b:]
        # Boundary context: the leaf before still ends in white space; leaves
        # after the region join in until it ends in white space again.
        while last + 1 < len(self.leaves) and text and text[-1] not in _SPACE:
            last += 1
            text += self.leaves[last]
        if len(text) > MOST_CHARS:
            before, after = self.leaves[:first], self.leaves[last + 1:]
            counts = self.tokens[self.size:self.size + len(self.leaves)]
            middle = _LEAF.findall(text)
            kept = [*counts[:first], *[self.encode(m) for m in middle], *counts[last + 1:]]
            leaves = [*before, *middle, *after]
            self.restore(leaves, kept)
            return
        for leaf in range(first + 1, last + 1):
            self.put(leaf, "", 0)
        self.put(first, text, self.encode(text))

    def restore(self, leaves: list[str], tokens: list[int]) -> None:
        """A tree over given leaves: sums only, nothing is encoded."""
        self.leaves = leaves
        self.size = 1 << max(len(leaves) - 1, 0).bit_length()
        self.tokens, self.chars = [0] * (2 * self.size), [0] * (2 * self.size)
        self.tokens[self.size:self.size + len(tokens)] = tokens
        self.chars[self.size:self.size + len(tokens)] = [len(leaf) for leaf in leaves]
        for i in range(self.size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def last(self) -> tuple[int, int]:
        """The end of the text: after the last leaf that is not empty."""
        place, at = self.find(self.chars[1] - 1)
        return place, at + 1

    def state(self) -> tuple[str, list[int], list[int]]:
        """The text, and characters and tokens of its leaves."""
        used = [(leaf, self.tokens[self.size + i]) for i, leaf in enumerate(self.leaves) if leaf]
        return "".join(leaf for leaf, _ in used), [len(leaf) for leaf, _ in used], [t for _, t in used]


def tree_of(text: str, chars: list[int], tokens: list[int], count: Callable[[str], int]) -> CountTree:
    """The tree a stored state describes, without encoding anything."""
    tree = CountTree.__new__(CountTree)
    tree.count, tree.encoded = count, 0
    ends = [0]
    for n in chars:
        ends.append(ends[-1] + n)
    tree.restore([text[a:b] for a, b in zip(ends[:-1], ends[1:])], list(tokens))
    return tree


def counter(path: str) -> Callable[[str], int]:
    ids = word_ids(path)
    return lambda text: len(ids(text)) // 4


def index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counting state of every whole text: ``doc_id, text, leaf_chars, leaf_tokens, n_tokens``.

    A null text is empty and has no leaves. Rows that repeat are indexed alike.
    """
    small_batches(docs.sparkSession)
    file = path or tokenizer_path()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("leaf_chars", T.ArrayType(T.IntegerType())),
                           T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file)
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column(1):
                leaves = _LEAF.findall(text.as_py() or "")
                chars.append([len(leaf) for leaf in leaves])
                tokens.append([count(leaf) for leaf in leaves])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())),
                 pa.array([sum(t) for t in tokens], pa.int64())], schema.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(apply, schema)


def apply_edits(state: DataFrame, edits: DataFrame, path: str | None = None, keep_text: bool = True) -> DataFrame:
    """The state after ``edits(doc_id, seq, start, length, insert)``, applied in the order of ``seq``.

    Returns the columns of the state with ``tokens_before``, ``n_edits`` and
    ``encoded_chars``, the characters that were encoded again. State and edits of
    a document meet in one sorted stream: a task holds one document, whatever
    the number of its edits.

    Defined results: places past the end mean the end; a null ``insert`` is empty,
    a null ``start`` 0, a null ``length`` 0; edits equal in ``seq`` follow the order
    of their other columns; edits without a document are ignored; of rows that
    share an id the last by text takes the edits, the others and rows without an
    id stay as they are. ``keep_text=False`` leaves text and leaves out.
    """
    small_batches(state.sparkSession)
    file = path or tokenizer_path()
    zero = lambda kind: F.lit(None).cast(kind)
    left = state.select("doc_id", F.lit(0).alias("kind"), zero("long").alias("seq"), zero("long").alias("start"), zero("long").alias("length"),
                        "text", "leaf_chars", "leaf_tokens")
    right = edits.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast(state.schema["doc_id"].dataType).alias("doc_id"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("start"), F.lit(0)).cast("long").alias("start"), F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length"),
        F.coalesce("insert", F.lit("")).alias("text"), zero("array<int>").alias("leaf_chars"), zero("array<int>").alias("leaf_tokens"))
    kept = [T.StructField("text", T.StringType()), T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([state.schema["doc_id"], *(kept if keep_text else []), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "tokens_before", "n_edits", "encoded_chars")]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file)
        rows: list[tuple] = []
        held, key = 0, None
        current: tuple | None = None
        types = [pa.int64(), *([pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] if keep_text else []), *[pa.int64()] * 4]

        def close() -> None:
            nonlocal held
            if current is not None:
                tree, before, n = current
                text = tree.state() if keep_text else ()
                rows.append((key, *text, tree.tokens[1], before, n, tree.encoded))
                held += tree.chars[1] if keep_text else 1

        def emit() -> pa.RecordBatch:
            nonlocal held
            held = 0
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], schema.names)
            rows.clear()
            return out

        for batch in batches:
            types[0] = batch.schema.field(0).type
            for i in range(batch.num_rows):
                doc, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                text = batch.column(5)[i].as_py()
                if kind == 0:
                    close()
                    tree = tree_of(text, batch.column(6)[i].as_py(), batch.column(7)[i].as_py(), count)
                    key, current = doc, (tree, tree.tokens[1], 0)
                elif current is not None and doc == key:
                    tree, before, n = current
                    tree.edit(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), text)
                    current = (tree, before, n + 1)
                if held > BATCH_CHARS:
                    yield emit()
        close()
        yield emit()

    named = left.filter(F.col("doc_id").isNotNull())
    stream = named.unionByName(right).repartition("doc_id").sortWithinPartitions("doc_id", "kind", "seq", "start", "length", "text")
    # Rows without an id go through without a shuffle: they could all be one key.
    return stream.mapInArrow(apply, schema).unionByName(left.filter(F.col("doc_id").isNull()).mapInArrow(apply, schema))


def edits_of(docs: DataFrame) -> DataFrame:
    """A log of three edits for every document, at places that follow from its id and length:
    a word replaced, a passage cut out, and a line put in, the last one inside a word as a rule."""
    n = F.length(F.coalesce("text", F.lit("")))
    place: Callable[[int], Column] = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), n + 1)
    edit = lambda i, length, insert: F.struct(F.lit(i).alias("seq"), place(i).alias("start"), F.lit(length).alias("length"), insert.alias("insert"))
    return docs.select("doc_id", F.explode(F.array(
        edit(1, 6, F.lit("Ersatz's 42")), edit(2, 120, F.lit("")),
        edit(3, 0, F.concat(F.lit(" naïve line, doc "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"))))).alias("e")).select("doc_id", "e.*")
