"""Operator 2: quality rules, a threshold table compiled into one Spark projection.

Each rule is a row of RULES: a numerator and a denominator among the measured counts, whole-number
bounds in per mille, and the rule's class.  ``compile_rules`` turns the table into one boolean
expression; there are no user functions.  Bounds are compared in integers, so verdicts are exact.

Results of odd input: null and empty texts have no words and fail; texts of under three words have no
repeated windows; repeated rows are judged one by one; further input columns, whatever their names,
are carried by ``judge`` and ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[ \x09-\x0D]+"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for as with was on are be this by or from at an not have "
    "der die das und den ist im von zu mit sich des auf nicht ein eine auch es dem als an "
    "le la les de des et en un une que qui dans pour par est sur pas ne il au du avec "
    "el los las y en un una que se por con para del al lo como su es"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a document if 1000 * count < least * of, or 1000 * count > most * of; of 0 never fails."""

    name: str
    kind: str
    count: str
    of: str
    least: int | None = None
    most: int | None = None


RULES = (
    Rule("word_length", "length", "word_chars", "n_words", 1500, 25000),
    Rule("symbols", "symbol", "n_symbols", "n_words", None, 250),
    Rule("exclamation", "symbol", "n_exclaimed", "n_words", None, 300),
    Rule("stop_words", "stop-word", "n_stop_words", "n_words", 20, None),
    Rule("duplicate_lines", "line", "n_dup_lines", "n_lines", None, 500),
    Rule("ellipsis_lines", "line", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("bullet_lines", "line", "n_bullet_lines", "n_lines", None, 900),
)
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def _word(x: str, k: int) -> str:
    """A word of a packed window (hash above, place in the low bits)."""
    return f"get(_words, {_place(x)} + {k})"


def _place(x: str) -> str:
    return f"cast({x} & (shiftleft(1L, _bits) - 1) as int)"


def _equal_hash(x: str, y: str) -> str:
    return f"shiftright({x}, _bits) = shiftright({y}, _bits)"


def measures(text: str = "text", hash_bits: int = 64) -> dict[str, str]:
    """Steps of SQL expressions, each over the columns of the steps before it.

    Windows are sorted by hash (at most ``hash_bits`` of it, less those of the place) and those with a hash in common are candidates.  If all
    neighbours of one hash are one sequence of words, they are the repeats; else the candidates are sorted by their words and compared again."""
    window = f"xxhash64(x, get(_words, i + 1), get(_words, i + 2)){'' if hash_bits == 64 else f' & {(1 << hash_bits) - 1}L'}"
    following = "get(_near, j + 1)"
    words = ", ".join(f"'w{k}', {_word('x', k)}" for k in range(3))
    agrees = " and ".join(f"{_word('x', k)} <=> {_word(following, k)}" for k in range(3))
    same = {side: " and ".join(f"x.w{k} <=> get(_keyed, j {side} 1).w{k}" for k in range(3)) for side in "-+"}
    stop = ", ".join(f"'{w}'" for w in sorted({x for w in STOP_WORDS for x in (w, w.capitalize())}))
    return {
        "_text": f"coalesce(`{text}`, '')",
        "_words": f"if(btrim(_text, '{WHITE}') = '', cast(array() as array<string>), split(btrim(_text, '{WHITE}'), '{SPLIT}'))".replace("\\x", "\\\\x"),
        "_lines": f"filter(split(_text, '\\n'), x -> btrim(x, '{WHITE}') <> '')",
        "_bits": "length(bin(size(_words)))",
        "_windows": f"sort_array(transform(_words, (x, i) -> shiftleft({window}, _bits) | i))",
        "_near": f"filter(_windows, (x, j) -> {_equal_hash('x', 'get(_windows, j - 1)')} or {_equal_hash('x', 'get(_windows, j + 1)')})",
        "_mixed": f"size(filter(_near, (x, j) -> {_equal_hash('x', following)} and not ({agrees}))) > 0",
        "_keyed": f"sort_array(transform(filter(_near, x -> _mixed), x -> named_struct({words}, 'i', {_place('x')})))",
        "_repeats": f"sort_array(if(_mixed, transform(filter(_keyed, (x, j) -> (j > 0 and {same['-']}) or (j < size(_keyed) - 1 and {same['+']})), x -> x.i), transform(_near, x -> {_place('x')})))",
        "n_words": "cast(size(_words) as bigint)",
        "word_chars": "cast(length(array_join(_words, '')) as bigint)",
        "n_symbols": "cast(regexp_count(_text, '[#*$%&|<>]') as bigint)",
        "n_exclaimed": "cast((length(_text) - length(replace(_text, '!!', ''))) / 2 as bigint)",
        "n_stop_words": f"cast(size(filter(_words, x -> x in ({stop}))) as bigint)",
        "n_lines": "cast(size(_lines) as bigint)",
        "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) as bigint)",
        "n_ellipsis_lines": "cast(size(filter(_lines, x -> endswith(x, '...'))) as bigint)",
        "n_bullet_lines": "cast(size(filter(_lines, x -> startswith(x, '- ') or startswith(x, '* '))) as bigint)",
        "n_repeat_words": "cast(aggregate(_repeats, named_struct('n', 0, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n) as bigint)",
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table fails."""
    tests = [f"1000 * {r.count} < {r.least} * {r.of}" for r in rules if r.least is not None]
    tests += [f"1000 * {r.count} > {r.most} * {r.of}" for r in rules if r.most is not None]
    return F.expr(f"not ({' or '.join(tests)})") if tests else F.lit(True)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "quality", hash_bits: int = 64) -> DataFrame:
    """The input with one more column: a struct of all counts, base_failed and kept."""
    inner = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_in"))
    steps = measures("_in", hash_bits)
    for group in (("_text",), ("_words", "_lines"), ("_bits",), ("_windows",), ("_near",), ("_mixed",), ("_keyed",), ("_repeats",)):
        inner = inner.withColumns({k: F.expr(steps[k]) for k in group})
    counts = [k for k in steps if not k.startswith("_")]
    inner = inner.select("_row", *(F.expr(steps[k]).alias(k) for k in counts))
    inner = inner.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"))
    inner = inner.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    # explode keeps a filter on the verdict above this point, where it would otherwise be inlined into every step below
    return inner.select("_row", F.explode(F.array(F.struct(*counts, "base_failed", "kept"))).alias(prefix)).select("_row.*", prefix)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = judge(docs)
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *(f"quality.{c}" for c in first), *(f"quality.{c}" for c in ("n_exclaimed", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines")))


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({x for w in STOP_WORDS for x in (w, w.capitalize())}))
    tests = [f"1000 * {r.count} < {r.least} * {r.of}" for r in RULES if r.least is not None] + [f"1000 * {r.count} > {r.most} * {r.of}" for r in RULES if r.most is not None]
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST((length(text) - length(replace(text, '!!', ''))) // 2 AS BIGINT) AS n_exclaimed,
  CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(list_filter(ls, lambda x: ends_with(x, '...'))) AS BIGINT) AS n_ellipsis_lines,
  CAST(len(list_filter(ls, lambda x: starts_with(x, '- ') OR starts_with(x, '* '))) AS BIGINT) AS n_bullet_lines FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept FROM b
"""


ORACLE_SQL = _oracle()
