"""Quality rules: a short-circuit cascade in the order of rejection per cost.

Every rule is a predicate on a text's measures. The basic measures are wanted for every text and are
counted for all; the rules decide about the texts that pass the basic test. A task judges its first
``SAMPLE_ROWS`` such texts and times the rules on them: the rule that rejects the largest share per
second comes first, then the one that does so among the texts that are left, and so on. A rule is
timed with all measures at hand that are counted before its turn (the basic ones, and those of the
rules before it), so it is charged for what it adds and no more. From then on a text that a rule
rejects sees no later one. The order never changes a verdict, only the work, so neither the sample
nor the clock reaches the result; each task has its own order, so that a source of its own kind is
judged by what is found there, and there is no pass of its own for the sample.

Words are the runs of bytes other than space, tab and line breaks, which is what ``bytes.split``
gives. Repeated windows: rolling 64-bit hashes say whether a text can have any; only then are
windows ranked exactly, by doubling (ranks of two words, of four, of eight).

Scale: one pass, no shuffle, one text at a time in a worker.

Defined cases: a null or empty text has no words and fails; repeated rows are each returned; a null
id is carried; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import copy
import time
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import utf8

SAMPLE_ROWS = 256
WINDOW = 8
COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def marked(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


DIGIT, LETTER = marked(b"0123456789"), marked(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
SYMBOL, BLANK = marked(b"#*$%&|<>"), marked(b" \t\n\v\f\r")
CAPITAL, SMALL = marked(bytes(range(65, 91))), marked(bytes(range(97, 123)))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """A text's measures; each is counted when it is first asked for."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.words = raw.split()
        self.n_words = len(self.words)
        self.codes = np.frombuffer(raw, np.uint8)

    @cached_property
    def word_chars(self) -> int:
        return int(((self.codes & 0xC0) != 0x80).sum() - BLANK[self.codes].sum())

    @cached_property
    def n_symbols(self) -> int:
        return int(SYMBOL[self.codes].sum())

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.split(None, 1)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        hashes = np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)
        rolled = hashes[:n].copy()
        for k in range(1, WINDOW):
            rolled *= MULTIPLIER
            rolled += hashes[k : k + n]
        rolled.sort()
        if not (rolled[1:] == rolled[:-1]).any():
            return 0
        number: dict[bytes, int] = {}
        ranks = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        span = 1
        while span < WINDOW:  # ranks of windows of twice the words, exactly
            pairs = ranks[: len(ranks) - span] * (int(ranks.max()) + 1) + ranks[span:]
            ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            span *= 2
        again = np.bincount(ranks)[ranks] > 1
        edge = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edge, np.flatnonzero(again), 1)
        np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
        return int((np.cumsum(edge)[:-1] > 0).sum())

    @cached_property
    def capitals(self) -> tuple[int, int]:
        upper = int(CAPITAL[self.codes].sum())
        return upper, upper + int(SMALL[self.codes].sum())

    @cached_property
    def digits(self) -> int:
        return int(DIGIT[self.codes].sum())

    @cached_property
    def lettered_words(self) -> int:
        """Words that hold a letter of A-Z or any character beyond ASCII."""
        if not self.n_words:
            return 0
        blank = BLANK[self.codes]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        return int(np.logical_or.reduceat(LETTER[self.codes], starts).sum())

    @cached_property
    def most_frequent(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def line_ends(self) -> tuple[int, int]:
        """Lines that start with a bullet, and lines that end with an ellipsis."""
        bullets = sum(x.lstrip(BLANKS).startswith((b"- ", b"* ", "\u2022".encode())) for x in self.lines)
        return bullets, sum(x.rstrip(BLANKS).endswith((b"...", "\u2026".encode())) for x in self.lines)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


BLANKS = b" \t\n\v\f\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: The rules: each says whether it rejects a text.
RULES = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "exclamations": lambda t: 4 * t.raw.count(b"!") > t.n_words,
    "capitals": lambda t: 10 * t.capitals[0] > 6 * t.capitals[1],
    "digits": lambda t: 5 * t.digits > t.word_chars,
    "no_letters": lambda t: 10 * t.lettered_words < 7 * t.n_words,
    "one_word": lambda t: 10 * t.most_frequent > 3 * t.n_words,
    "bullets": lambda t: 10 * t.line_ends[0] > 9 * len(t.lines) and len(t.lines) > 1,
    "ellipses": lambda t: 10 * t.line_ends[1] > 3 * len(t.lines) and len(t.lines) > 1,
    "placeholder": lambda t: b"lorem ipsum" in t.raw.lower(),
    "code": lambda t: 50 * (t.raw.count(b"{") + t.raw.count(b"}")) > t.n_words,
    "broken": lambda t: 100 * t.raw.count("\ufffd".encode()) > t.n_words,
}


def timed(rejects, texts: list[Text]) -> tuple[int, float]:
    """Texts rejected, and seconds; on copies, so that what the rule counts is not at hand for the others."""
    copies = [copy.copy(t) for t in texts]
    began = time.perf_counter()
    rejected = sum(map(rejects, copies))
    return rejected, max(1e-9, time.perf_counter() - began)


def cascade_order(texts: list[Text], rules=None) -> list[str]:
    """Rule names by rejection per cost, each among the texts that those before it leave; ties by name."""
    rules = rules or RULES
    for t in texts:
        for name in BASE:
            getattr(t, name)
    order, left = [], list(rules)
    while left:
        worth = {}
        for name in left:
            rejected, seconds = timed(rules[name], texts)
            worth[name] = rejected / seconds if rejected else -seconds
        order.append(min(left, key=lambda name: (-worth[name], name)))
        left.remove(order[-1])
        texts = [t for t in texts if not rules[order[-1]](t)]
    return order


def judge(rules=None):
    rules = rules or RULES

    def run(batches):
        order, sample = list(rules), []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for raw in batch.column(1).slice(at, 512).to_pylist():
                    t = Text(raw)
                    failed = t.base_failed or any(rules[name](t) for name in order)
                    rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, not failed))
                    if sample is not None and not t.base_failed:
                        sample.append(Text(raw))
                        if len(sample) >= SAMPLE_ROWS:
                            order, sample = cascade_order(sample, rules), None
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
                names = [part.split()[0] for part in COLUMNS.split(", ")]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), *columns], names=names)

    return run


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """The measures and the verdict of every row."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return given.mapInArrow(judge(rules), COLUMNS)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return filter_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT n, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*([-*] |\x{2022})')) AS bullets,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) AS ellipses
  FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n
), v AS (
  SELECT n, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT n, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twice AS (
  SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, s) AS c FROM v) WHERE c > 1
), f AS (
  SELECT n, max(c) AS most FROM (SELECT n, word, count(*) AS c FROM (SELECT n, unnest(w) AS word FROM d) GROUP BY n, word) GROUP BY n
), covered AS (
  SELECT n, count(DISTINCT i + k) AS n_repeat FROM twice, range(8) AS r(k) GROUP BY n
), m AS (
  SELECT n, doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^!]', '', 'g')) AS marks, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^{}]', '', 'g')) AS braces, length(regexp_replace(text, '[^\x{FFFD}]', '', 'g')) AS broken,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered, coalesce(most, 0) AS most, coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses
  FROM d LEFT JOIN l USING (n) LEFT JOIN covered USING (n) LEFT JOIN f USING (n)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 4 * marks > n_words OR 10 * upper > 6 * letters OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * digits > word_chars OR 10 * lettered < 7 * n_words OR 10 * most > 3 * n_words
            OR (n_lines > 1 AND (10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines)) OR contains(lower(text), 'lorem ipsum') OR 50 * braces > n_words OR 100 * broken > n_words) AS kept
FROM b
"""
