"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt by a seeded random number to partitions and put in its order, so what stands
next to each other is a random sample of the corpus, whatever the order of the input, and rows that
are repeated however often spread over all partitions. A
group is a run of documents of up to ``GROUP_TOKENS`` tokens; each group is packed on its own.

Within a group a document longer than a sequence is cut into full sequences and a rest. Rests go,
longest first, each into the first open bin with room. A tournament tree over the bins' free room
finds that bin in logarithmic time. Sequence numbers are the partition's number and a counter.

Tokens: where no token crosses ASCII white space and case does not matter, a text is tokenised word by
word; each worker remembers words it has met, up to a bound, and asks the tokenizer only for new
ones. That is so for the lower-casing vocabulary with ends of words that the query uses. Each worker
tries it on ``PROBES`` and on its first ``CHECKED`` texts, and tokenises whole texts with any
tokenizer that gives other ids there.

Scale: one shuffle of the texts; no second one for the tokens, since each group is tokenised and
packed where it lies. A worker holds one group and the word memory. A lost executor's partitions
come out the same again, since their order is total up to rows that are equal.

Defined cases: a null or empty text has only the closing token; a null id is carried; repeated
rows are packed each on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import give_back, utf8

SEQUENCE = 4096
GROUP_TOKENS = 2_000_000
END_ID = 2
#: Above this many words a worker forgets all and starts again; a thousand take about 0.15 MB.
WORD_MEMORY = 1_000_000
#: Texts that show whether a tokenizer can be asked word by word.
CHECKED = 64
PROBES = [
    b"The quick brown fox, it's 3.14 (or 42)! cafe\xcc\x81 caf\xc3\xa9 \xc3\x9cBER stra\xc3\x9fe", b"one  two\t three\n\nfour\r\nfive", b" leading and trailing ", b"don't re-enter e-mail user@example.com https://a.b/c?d=e#f",
    b"$#@!%^&*() [x]{y}<z> a|b a_b `c` \"d\" 'e' ...", b"UPPER lower MiXed camelCase snake_case 1st 2nd 1,000.50", "\u4eba\u4eba\u751f \u0416\u0443\u043a \U0001f600 \u0130 \ufb01 \u00a0x\u2028y".encode(), b"a\x00b \x1c c", b"<|endoftext|> <|x|>",
]
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Lower-case letters that neither normalisation nor the pattern of the tokenizer can split.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Such letters and then marks, which are tokenised apart from them.
STEM_AND_MARKS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,!?;:#$%&*|]+)")


class Words:
    """Token ids (little-endian, four bytes each) of texts, by white-space word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = bytearray(max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.most = WORD_MEMORY
        self.whole, self.unchecked = self.by_word(PROBES) != self.by_text(PROBES), CHECKED

    def by_text(self, texts: list[bytes]) -> list[bytes]:
        encoded = (self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False) for t in texts)
        return [array.array("I", e.ids).tobytes() for e in encoded]

    def encode_each(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.known.update((w, array.array("I", e.ids).tobytes()) for w, e in zip(part, encoded, strict=True))

    def encode_joined(self, words: list[bytes]) -> None:
        """Words of letters only: one call for many, whose tokens are told apart by the ends of words."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids
            raw, ends = array.array("I", ids).tobytes(), self.ends
            stops = [4 * (k + 1) for k, number in enumerate(ids) if ends[number]]
            if len(stops) != len(part):
                self.encode_each(part)
                continue
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True))

    def learn(self, new: set[bytes]) -> None:
        known, plain, others, marked = self.known, [], [], []
        for w in new:
            if w.isalpha():
                plain.append(w)
            elif m := STEM_AND_MARKS.fullmatch(w):
                marked.append((w, *m.groups()))
            else:
                (plain if LETTERS.fullmatch(w) else others).append(w)
        stems = {stem for _, stem, _ in marked}.difference(known, new)
        self.encode_joined([*plain, *stems])
        self.encode_each([*others, *{marks for *_, marks in marked}.difference(known, new)])
        for w, stem, marks in marked:
            known[w] = known[stem] + known[marks]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.whole and self.unchecked:
            some = texts[: self.unchecked]
            self.whole, self.unchecked = self.by_word(some) != self.by_text(some), self.unchecked - len(some)
        return self.by_text(texts) if self.whole else self.by_word(texts)

    def by_word(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        # the tokenizer lower-cases too; special tokens are found before it does, so texts that may hold one stay
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        get = self.known.get
        found = [list(map(get, words)) for words in split]
        gaps = [[k for k, ids in enumerate(row) if ids is None] if None in row else () for row in found]
        new = {words[k] for words, row in zip(split, gaps, strict=True) for k in row}
        if new:
            self.learn(new)
            for words, row, missing in zip(split, found, gaps, strict=True):
                for k in missing:
                    row[k] = self.known[words[k]]
        return [b"".join(row) for row in found]


WORKERS: dict[str, Words] = {}


def words_for(path: str, most: int = WORD_MEMORY) -> Words:
    if path not in WORKERS:
        WORKERS[path] = Words(path)
    WORKERS[path].most = most
    return WORKERS[path]


class Tournament:
    """Free room by bin; ``first(n)`` is the lowest bin with room for ``n``."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        node = 1
        while node < self.leaves:
            node *= 2
            if self.best[node] < need:
                node += 1
        return node - self.leaves

    def take(self, at: int, need: int) -> int:
        """Room left in bin ``at`` after ``need``; winners on the way up are played again."""
        node = at + self.leaves
        self.best[node] -= need
        left = self.best[node]
        while node > 1:
            node //= 2
            best = max(self.best[2 * node], self.best[2 * node + 1])
            if self.best[node] == best:
                break
            self.best[node] = best
        return left


def pack(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    out, rests, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        full = n // size
        out += [(doc, k * size, size, sequence + k, 0) for k in range(full)]
        sequence += full
        if n % size:
            rests.append((n % size, doc, full * size))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(max(1, len(rests)), size)
    for n, doc, start in rests:
        at = tree.first(n)
        offset = size - tree.best[at + tree.leaves]
        tree.take(at, n)
        out.append((doc, start, n, sequence + at, offset))
    return out


def packer(path: str, size: int, end_id: int, group_tokens: int, word_memory: int = WORD_MEMORY):
    end = array.array("I", [end_id]).tobytes()

    def emit(ids, docs, base):
        lengths = [len(docs[i]) // 4 for i in range(len(docs))]
        pieces = pack(lengths, size)
        columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 5
        batch = pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([ids[d] for d in columns[0]], pa.int64()),
                "start": pa.array(columns[1], pa.int64()),
                "length": pa.array(columns[2], pa.int64()),
                "ids": pa.array([docs[d][4 * s : 4 * (s + n)] for d, s, n, *_ in pieces], pa.binary()),
                "doc_tokens": pa.array([lengths[d] for d in columns[0]], pa.int64()),
                "sequence_id": pa.array([base + s for s in columns[3]], pa.int64()),
                "offset": pa.array(columns[4], pa.int64()),
            }
        )
        return batch, (max(columns[3]) + 1 if pieces else 0)

    def run(batches):
        from pyspark import TaskContext

        words, base = words_for(path, word_memory), TaskContext.get().partitionId() << 40
        ids, docs, tokens = [], [], 0
        for batch in batches:
            id_col, text_col = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 512):
                texts = text_col.slice(at, 512).to_pylist()
                for doc_id, coded in zip(id_col.slice(at, 512).to_pylist(), words.ids(texts), strict=True):
                    ids.append(doc_id)
                    docs.append(coded + end)
                    tokens += len(coded) // 4 + 1
                    if tokens >= group_tokens:
                        out, n = emit(ids, docs, base)
                        yield out
                        base, ids, docs, tokens = base + n, [], [], 0
        if docs:
            yield emit(ids, docs, base)[0]
        ids, docs = [], []
        give_back()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
    seed: int = 11,
    word_memory: int = WORD_MEMORY,
) -> DataFrame:
    """A row for each piece, with its ids as little-endian unsigned 32-bit numbers in ``ids``; ``word_memory`` bounds what a worker remembers."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    given = given.withColumn("draw", F.rand(seed))
    dealt = given.repartition("draw").sortWithinPartitions("draw", "doc_id").select("doc_id", "text")
    return dealt.mapInArrow(packer(tokenizer_path, size, end_id, group_tokens, word_memory), PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
