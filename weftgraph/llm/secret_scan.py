"""Secret scans: fixed patterns, and a randomness test battery for every other long token.

Spans of the patterns come from the texts themselves: the pieces between matches and the matches
give every start and end, in code points, without leaving the JVM.

The battery takes each maximal run of ``[A-Za-z0-9+/_-]`` of 24 or more characters, infers its
encoding (hex, base 32, letters, base 62, base 64) and asks two questions.

*Can it be random?* Three tests of "uniform over that alphabet": (1) chi-squared of symbol counts,
(2) Wald-Wolfowitz runs of symbols above and below the middle of the alphabet, (3) lag-1 serial
correlation; combined by Bonferroni. A token that they reject at ``PATTERNED`` is no finding.

*Can it be text?* The null hypothesis is a name, path or run of words over the same alphabet:
symbols that agree with probability ``TEXT[...][0]`` and change between capitals, small letters,
digits and signs with probability ``TEXT[...][1]``. Chi-squared is then non-central, and the number
of changes is binomial; both grow with the length, so short tokens get no small p-value. The two
normal scores are added (Stouffer).

False discoveries are those findings that are text, so the Benjamini-Hochberg step-up procedure at
level ``ALPHA`` runs on the p-values of the second question, within each class (encoding by length
band) and over the whole corpus; what it rejects, and the first question admits, is a finding. Where
secrets are rarer, a token needs more length to be one. The step-up works on counts of p-values on a
logarithmic grid, so that the corpus sends the driver at most ``GRID`` rows a class and never its
tokens; p-values are rounded up to the grid, so the level holds as far as the null model does.

Scale: texts are scanned once and the spans written out; the work is linear in a text's length and
in its spans, but for chunks of ``CHUNK`` spans.

Defined cases: a null or empty text has no span; repeated rows are each returned; an empty table
gives an empty result; other columns are ignored, whatever their names; a token that overlaps a
pattern's span adds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import fresh
from weftgraph.session import cut

#: The patterns, by kind, in order; the group that counts and its least length.
PATTERNS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: What a text must hold for a pattern to have any chance; saves most texts the search.
NEEDS = {"assign": [":", "="], "access": ["AKIA"]}
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"

#: Alphabet size and the least length by encoding.
ENCODINGS = {"hex": (16, 32), "base32": (32, 32), "letters": (52, 36), "base62": (62, 24), "base64": (64, 24)}
#: The null hypothesis of text by encoding: how often two of its symbols agree, and two neighbours differ in class.
TEXT = {"hex": (0.12, 0.3), "base32": (0.06, 0.12), "letters": (0.05, 0.3), "base62": (0.04, 0.35), "base64": (0.04, 0.35)}
#: A run of characters of one class.
CLASSES = "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"
ALPHA, PATTERNED = 0.01, 0.001
GRID = 160
CHUNK = 256
#: Symbols in the order that the runs and serial tests give them.
ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"


def pieces(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; within lambdas Spark would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, step) -> Column:
    """The state after each of ``numbers`` (integers), from 0; an array grows in chunks, so that long ones stay linear."""
    chunks = bound(numbers, lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(xs, i + 1, F.lit(CHUNK))))
    grown = F.aggregate(
        chunks,
        F.array(F.array(F.lit(0))),
        lambda done, chunk: F.array_append(done, F.aggregate(chunk, F.array(F.element_at(F.element_at(done, -1), -1)), lambda states, x: F.array_append(states, step(F.element_at(states, -1), x)))),
    )
    return F.flatten(F.transform(bound(grown, lambda g: F.slice(g, F.lit(2), F.size(g))), lambda states: F.slice(states, F.lit(2), F.size(states))))


def spans_of(matches: Column, groups: Column | None, between: Column, kind: str, rank: int, least: int) -> Column:
    """Spans of the matches, from their lengths and the lengths of the pieces between them."""
    lengths = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, p: F.length(p) + F.length(m))
    walked = F.zip_with(
        running(lengths, lambda at, n: at + n),
        matches,
        lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")),
    )
    if groups is not None:
        walked = F.transform(
            F.filter(F.zip_with(walked, groups, lambda s, g: F.struct(s.alias("s"), F.length(g).alias("n"))), lambda x: x["n"] >= least),
            lambda x: x["s"],
        )
    return F.when(F.size(matches) > 0, walked).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def encoding_of(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return (
        F.when(token.rlike("^[0-9a-f]+$") & mixed, "hex")
        .when(token.rlike("^[0-9A-F]+$") & mixed, "hex")
        .when(token.rlike("^[A-Z2-7]+$") & mixed, "base32")
        .when(token.rlike("^[A-Za-z]+$"), "letters")
        .when(token.rlike("^[A-Za-z0-9]+$") & mixed, "base62")
        .when(token.rlike("^[A-Za-z0-9+/_-]+$") & mixed & ~token.rlike("[+/_-]{2}"), "base64")
    )


def struct_with(x: Column, kept: list[str], **more: Column) -> Column:
    return F.struct(*(x[name].alias(name) for name in kept), *(c.alias(name) for name, c in more.items()))


def by_encoding(encoding: Column, which: int, table: dict | None = None) -> Column:
    out = F.lit(None).cast("double")
    for name, sizes in (table or ENCODINGS).items():
        out = F.when(encoding == name, F.lit(float(sizes[which]))).otherwise(out)
    return out


def tail(z: Column) -> Column:
    """P(Z > z)."""
    return F.when(z > 0, normal_tail(z)).otherwise(1 - normal_tail(-z))


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))


def graded(tokens: Column) -> Column:
    """Tokens (start, end, token) that are long enough for their encoding: class, whether they can be random, bin of the p-value of text."""
    named = F.filter(
        F.transform(tokens, lambda x: struct_with(x, ["start", "end", "token"], encoding=encoding_of(x["token"]))),
        lambda x: F.length(x["token"]) >= by_encoding(x["encoding"], 1),
    )
    spelled = F.transform(
        named,
        lambda x: struct_with(
            x,
            ["start", "end", "encoding"],
            k=by_encoding(x["encoding"], 0),
            n=F.length(x["token"]).cast("double"),
            folded=F.when(x["encoding"] == "hex", F.lower(x["token"])).otherwise(x["token"]),
            order=F.when(x["encoding"] == "hex", F.lit("0123456789abcdef")).when(x["encoding"] == "base32", F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).otherwise(F.lit(ORDER)),
        ),
    )
    coded = F.transform(
        F.transform(spelled, lambda x: struct_with(x, ["start", "end", "encoding", "k", "n", "folded", "order"], chars=F.regexp_extract_all(x["folded"], F.lit("."), F.lit(0)), classes=F.size(F.regexp_extract_all(x["folded"], F.lit(CLASSES), F.lit(0))).cast("double"))),
        lambda x: struct_with(
            x,
            ["start", "end", "encoding", "k", "n", "classes"],
            squares=F.aggregate(
                F.array_distinct(x["chars"]),
                F.lit(0.0),
                lambda acc, c: acc + F.pow(x["n"] - F.length(F.replace(x["folded"], c, F.lit(""))), F.lit(2.0)),
            ),
            ranks=F.transform(x["chars"], lambda c: F.position(c, x["order"]).cast("double")),
        ),
    )
    coded = F.transform(  # "-" and "_" stand for "+" and "/"
        coded, lambda x: struct_with(x, ["start", "end", "encoding", "k", "n", "classes", "squares"], ranks=F.transform(x["ranks"], lambda r: F.when(r > 64, r - 2).otherwise(r)))
    )
    centred = F.transform(
        coded,
        lambda x: struct_with(
            x,
            ["start", "end", "encoding", "k", "n", "classes", "squares", "ranks"],
            mean=F.aggregate(x["ranks"], F.lit(0.0), lambda acc, r: acc + r) / x["n"],
        ),
    )
    pairs = lambda x: F.zip_with(F.slice(x["ranks"], F.lit(1), (x["n"] - 1).cast("int")), F.slice(x["ranks"], F.lit(2), (x["n"] - 1).cast("int")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    measured = F.transform(
        centred,
        lambda x: struct_with(
            x,
            ["start", "end", "encoding", "k", "n", "classes"],
            more=x["n"] * (x["k"] * by_encoding(x["encoding"], 0, TEXT) - 1),
            change=by_encoding(x["encoding"], 1, TEXT),
            chi=x["squares"] * x["k"] / x["n"] - x["n"],
            changes=F.aggregate(pairs(x), F.lit(0.0), lambda acc, p: acc + F.when((p["a"] > x["k"] / 2) != (p["b"] > x["k"] / 2), 1.0).otherwise(0.0)),
            joint=F.aggregate(pairs(x), F.lit(0.0), lambda acc, p: acc + (p["a"] - x["mean"]) * (p["b"] - x["mean"])),
            spread=F.aggregate(x["ranks"], F.lit(0.0), lambda acc, r: acc + (r - x["mean"]) * (r - x["mean"])),
        ),
    )
    # the cube root of chi squared is nearly normal (Wilson and Hilferty)
    scored = F.transform(
        measured,
        lambda x: struct_with(
            x,
            ["start", "end", "encoding", "n"],
            text_chi_z=(x["k"] - 1 + x["more"] - x["chi"]) / F.sqrt(2 * (x["k"] - 1 + 2 * x["more"])),
            text_change_z=(x["classes"] - 1 - (x["n"] - 1) * x["change"]) / F.sqrt((x["n"] - 1) * x["change"] * (1 - x["change"])),
            chi_z=(F.pow(F.greatest(x["chi"], F.lit(0.0)) / (x["k"] - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (x["k"] - 1)))) / F.sqrt(2 / (9 * (x["k"] - 1))),
            runs_z=(2 * x["changes"] - (x["n"] - 1)) / F.sqrt(x["n"] - 1),
            serial_z=F.when(x["spread"] > 0, x["joint"] / x["spread"] * F.sqrt(x["n"])).otherwise(F.sqrt(x["n"])),
        ),
    )
    tested = F.transform(
        scored,
        lambda x: struct_with(
            x,
            ["start", "end", "encoding", "n"],
            p=F.least(
                F.lit(1.0),
                3 * F.least(tail(x["chi_z"]), two_sided(x["runs_z"]), two_sided(x["serial_z"])),
            ),
            text_p=tail((x["text_chi_z"] + x["text_change_z"]) / math.sqrt(2)),
        ),
    )
    band = lambda n: F.when(n < 32, "24").when(n < 48, "32").when(n < 64, "48").when(n < 128, "64").otherwise("128")
    return F.transform(
        tested,
        lambda x: struct_with(
            x,
            ["start", "end"],
            cls=F.concat(x["encoding"], F.lit(":"), band(x["n"])),
            random=x["p"] >= PATTERNED,
            bin=F.floor(F.least(F.lit(GRID / 8 - 0.01), -F.log10(F.greatest(x["text_p"], F.lit(1e-30)))) * 8).cast("int"),
        ),
    )


def apart(base: Column, tokens: Column) -> Column:
    """The tokens (start, end, token) that no span of ``base`` meets: at a token's end, the farthest end of all spans begun is not past its start."""
    event = lambda key, query, reach, start, token: F.struct(key.alias("key"), F.lit(query).alias("span"), reach.alias("reach"), start.alias("start"), token.alias("token"))
    spans = F.transform(base, lambda s: event(s["start"], 1, s["end"], F.lit(0), F.lit(None).cast("string")))
    asked = F.transform(tokens, lambda t: event(t["end"], 0, F.lit(0), t["start"], t["token"]))
    events = F.array_sort(F.concat(spans, asked))
    met = F.zip_with(events, running(F.transform(events, lambda e: e["reach"]), F.greatest), lambda e, far: F.struct(e.alias("e"), far.alias("far")))
    free = F.filter(met, lambda x: (x["e"]["span"] == 0) & (x["far"] <= x["e"]["start"]))
    return F.transform(free, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["key"].alias("end"), x["e"]["token"].alias("token")))


def annotate(docs: DataFrame, text_col: str = "text", kept: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """The columns ``kept`` (all) of ``docs`` with two more, and their names: the patterns' spans, and the graded tokens that touch none."""
    kinds = [kind for kind, *_ in PATTERNS]
    base, tokens, text, m_token, s_token, *rest = fresh(docs, "base", "tokens", "whole", "m_token", "s_token", *(f"{x}_{kind}" for kind in kinds for x in "ms"))
    m, s = dict(zip(kinds, rest[0::2], strict=True)), dict(zip(kinds, rest[1::2], strict=True))
    out = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    wanted = {m_token: F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))}
    for kind, pattern, _, _ in PATTERNS:
        chance = F.lit(kind not in NEEDS)
        for part in NEEDS.get(kind, []):
            chance = chance | F.contains(text, F.lit(part))
        wanted[m[kind]] = F.when(chance, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns(wanted)
    spans = {}
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
        spans[s[kind]] = spans_of(F.col(m[kind]), groups, pieces(F.col(text), pattern), kind, rank, least)
    token_spans = spans_of(F.col(m_token), None, pieces(F.col(text), TOKEN), "random", len(PATTERNS), 0)
    spans[s_token] = F.zip_with(token_spans, F.col(m_token), lambda x, t: F.struct(x["start"].alias("start"), x["end"].alias("end"), t.alias("token")))
    out = out.withColumns(spans)
    out = out.withColumn(base, F.array_sort(F.concat(*(F.col(s[kind]) for kind in kinds))))
    free = F.when(F.size(s_token) > 0, F.when(F.size(base) > 0, apart(F.col(base), F.col(s_token))).otherwise(F.col(s_token)))
    out = out.withColumn(s_token, free)
    none = F.array().cast("array<struct<start:int,end:int,cls:string,random:boolean,bin:int>>")
    out = out.withColumn(tokens, F.when(F.size(s_token) > 0, graded(F.col(s_token))).otherwise(none))
    return out.select(*(docs.columns if kept is None else kept), base, tokens), base, tokens


def step_up(counts: dict[int, int], alpha: float) -> int:
    """Benjamini-Hochberg on a grid: the least bin whose tokens are rejected as text (GRID if none)."""
    total, seen, least = sum(counts.values()), 0, GRID
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if 10 ** (-b / 8) <= alpha * seen / total:
            least = b
    return least


def thresholds(annotated: DataFrame, tokens: str, alpha: float = ALPHA) -> dict[str, int]:
    """By class, the bin from which tokens are not text. At most GRID rows a class (25 classes) reach the driver."""
    rows = annotated.select(F.explode(tokens).alias("t")).groupBy("t.cls", "t.bin").count().collect()
    by: dict[str, dict[int, int]] = {}
    for cls, b, n in rows:
        by.setdefault(cls, {})[b] = n
    return {cls: step_up(counts, alpha) for cls, counts in by.items()}


def scan(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, kept: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """The columns ``kept`` (all) of ``docs`` with two more, and their names: the patterns' spans, and those with the battery's findings.

    Rows are scanned once and written out with their spans; the step-up and the result read that table."""
    seen, base, tokens = annotate(docs, text_col, kept)
    seen = cut(seen)
    least = thresholds(seen, tokens, alpha)
    known = F.create_map(*(x for cls, b in sorted(least.items()) for x in (F.lit(cls), F.lit(b)))) if least else None
    found = F.filter(tokens, lambda t: t["random"] & (t["bin"] >= F.element_at(known, t["cls"]))) if least else F.filter(tokens, lambda t: F.lit(False))
    extra = F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), F.lit("random").alias("kind"), t["end"].alias("end")))
    return seen.withColumn(tokens, F.array_sort(F.concat(base, extra))), base, tokens


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each of the sorted ``spans`` replaced (those that overlap by one). It is cut at every CHUNK-th span first, since finding a place in a text takes time in proportion to the place."""
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    walked = F.zip_with(spans, F.concat(F.array(F.lit(0)), ends), lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))
    walked = F.filter(walked, lambda x: x["start"] >= x["at"])  # the last of the zip has no span
    chunks = bound(walked, lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(CHUNK)), lambda i: F.slice(w, i, F.lit(CHUNK))))
    parts = F.transform(chunks, lambda c: F.struct(c.alias("c"), F.get(c, F.lit(0))["at"].alias("from"), F.substring(text, F.get(c, F.lit(0))["at"] + 1, F.element_at(c, -1)["start"] - F.get(c, F.lit(0))["at"]).alias("part")))
    kept = F.transform(parts, lambda x: F.array_join(F.transform(x["c"], lambda s: F.concat(F.substring(x["part"], s["at"] - x["from"] + 1, s["start"] - s["at"]), F.lit(mask))), ""))
    rest = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with every span in the text replaced by ``mask`` (overlapping spans by one); a null text stays null."""
    found, _, spans = scan(docs, text_col, alpha)
    return found.withColumn(text_col, masked(F.col(text_col), F.col(spans), mask)).select(*docs.columns)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found, base, spans = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), kept=["doc_id"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(of(kind) for kind, *_ in PATTERNS), F.sha2(listed(F.col(base)), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans")
    )


def tail_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * {z}))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r} * {poly})"


def oracle() -> str:
    """The same spans in DuckDB: matches, pieces, battery and step-up."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = []
    for rank, (kind, pattern, group, _) in enumerate([*PATTERNS, ("random", TOKEN.split(")", 1)[1], 0, 0)]):
        p = quoted(pattern)
        found.append(f"SELECT n, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS g, string_split_regex(text, {p}) AS p FROM d")
    size = lambda which: "CASE enc " + " ".join(f"WHEN '{name}' THEN {sizes[which]}" for name, sizes in ENCODINGS.items()) + " END"
    null = lambda which: "CASE enc " + " ".join(f"WHEN '{name}' THEN {TEXT[name][which]}::DOUBLE" for name in ENCODINGS) + " END"
    above = lambda z: f"(CASE WHEN {z} > 0 THEN {tail_sql(z)} ELSE 1 - {tail_sql(f'(-{z})')} END)"
    total = lambda items, body: f"coalesce(list_sum(list_transform({items}, lambda x: {body})), 0)"
    two = lambda z: f"least(1.0, 2 * {tail_sql(f'abs({z})')})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(found)}),
one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
span AS (SELECT n, rank, kind, m[i] AS token, g[i] AS part, ({total("p[1:i]", "length(x)")} + {total("m[1:i - 1]", "length(x)")})::BIGINT AS start FROM one),
base AS (SELECT n, rank, kind, start, start + length(token) AS stop FROM span WHERE rank < 3 AND (rank > 0 OR length(part) >= 8)),
named AS (SELECT n, start, token, length(token)::DOUBLE AS l, regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z]') AS mixed,
  CASE WHEN (regexp_matches(token, '^[0-9a-f]+$') OR regexp_matches(token, '^[0-9A-F]+$')) AND mixed THEN 'hex' WHEN regexp_matches(token, '^[A-Z2-7]+$') AND mixed THEN 'base32'
       WHEN regexp_matches(token, '^[A-Za-z]+$') THEN 'letters' WHEN regexp_matches(token, '^[A-Za-z0-9]+$') AND mixed THEN 'base62'
       WHEN mixed AND NOT regexp_matches(token, '[+/_-]{{2}}') THEN 'base64' END AS enc FROM span WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = span.n AND b.start < span.start + length(span.token) AND span.start < b.stop)),
long AS (SELECT *, ({size(0)})::DOUBLE AS k, CASE enc WHEN 'hex' THEN lower(token) ELSE token END AS folded,
  CASE enc WHEN 'hex' THEN '0123456789abcdef' WHEN 'base32' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' ELSE '{ORDER}' END AS ord FROM named WHERE l >= {size(1)}),
coded AS (SELECT *, string_split(folded, '') AS chars FROM long),
ranked AS (SELECT *, {total("list_distinct(chars)", "pow(l - length(replace(folded, x, '')), 2)")} AS squares, list_transform(chars, lambda x: CASE WHEN strpos(ord, x) > 64 THEN strpos(ord, x) - 2 ELSE strpos(ord, x) END::DOUBLE) AS r FROM coded),
centred AS (SELECT *, list_sum(r) / l AS mean, list_zip(r[1:len(r) - 1], r[2:]) AS pairs FROM ranked),
measured AS (SELECT *, squares * k / l - l AS chi, {total("pairs", "CASE WHEN (x[1] > k / 2) <> (x[2] > k / 2) THEN 1.0::DOUBLE ELSE 0.0 END")} AS changes,
  len(regexp_extract_all(folded, '{CLASSES}'))::DOUBLE AS classes, l * (k * ({null(0)}) - 1) AS more, ({null(1)})::DOUBLE AS rate,
  {total("pairs", "(x[1] - mean) * (x[2] - mean)")} AS joint, {total("r", "(x - mean) * (x - mean)")} AS spread FROM centred),
scored AS (SELECT *, (pow(greatest(chi, 0) / (k - 1), 1 / 3::DOUBLE) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS chi_z, (2 * changes - (l - 1)) / sqrt(l - 1) AS runs_z,
  CASE WHEN spread > 0 THEN joint / spread * sqrt(l) ELSE sqrt(l) END AS serial_z,
  ((k - 1 + more - chi) / sqrt(2 * (k - 1 + 2 * more)) + (classes - 1 - (l - 1) * rate) / sqrt((l - 1) * rate * (1 - rate))) / sqrt(2) AS text_z FROM measured),
tested AS (SELECT n, start, start + l::BIGINT AS stop, enc || ':' || CASE WHEN l < 32 THEN '24' WHEN l < 48 THEN '32' WHEN l < 64 THEN '48' WHEN l < 128 THEN '64' ELSE '128' END AS cls,
  least(1.0, 3 * least({above("chi_z")}, {two("runs_z")}, {two("serial_z")})) AS pv, {above("text_z")} AS text_p FROM scored),
binned AS (SELECT *, floor(least({GRID / 8 - 0.01}, -log10(greatest(text_p, 1e-30))) * 8)::INT AS bin FROM tested),
counted AS (SELECT cls, bin, sum(count(*)) OVER (PARTITION BY cls ORDER BY bin DESC) AS cum, sum(count(*)) OVER (PARTITION BY cls) AS total FROM binned GROUP BY cls, bin),
cuts AS (SELECT cls, coalesce(min(bin) FILTER (pow(10, -bin / 8) <= {ALPHA} * cum / total), {GRID}) AS cut FROM counted GROUP BY cls),
extra AS (SELECT n, 3 AS rank, 'random' AS kind, start, stop FROM binned t JOIN cuts USING (cls) WHERE bin >= cut AND pv >= {PATTERNED}),
shown AS (SELECT n, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY n),
basic AS (SELECT n, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM base GROUP BY n)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(basic.spans, '')) AS base_sha256, coalesce(shown.spans, '') AS spans
FROM d LEFT JOIN basic USING (n) LEFT JOIN shown USING (n)
"""
