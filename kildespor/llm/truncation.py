r"""Texts that lost their end where a source cuts its fields or a transfer broke off.

Method: word trigrams inside texts against those at ends, in SQL. A text is
flagged when its final trigram stands inside texts but ends them far more seldom
(``LIFT``) than a place chosen by chance would. How often a trigram ends texts is
measured as a lift, ends over the ends expected by chance, and every measure
leans on the next coarser one by ``LEAN`` expected ends, so what is seen often
speaks for itself and what is seen seldom hardly does, at every size of corpus or
source: the trigram of words (over all texts, a text's own end and equal texts
left out), the trigram of classes in the text's source, the class of the final
token in the source, that class in all sources. Classes are a lower-case word, a
capitalised one, a number, else the mark itself; words that mostly stand near
ends (signatures, a closing formula) are classes of their own.

Named rules beside it catch ends that trigrams can't tell:

* ``at_limit``: as long, in characters or bytes, as the longest of its source, many
  others are, and without a full stop;
* ``fragment``: the final word never stands inside any text and is the beginning of
  a word that does, or has an ending that words don't have;
* ``open``: it ends in a word inside a bracket or quotation that is still open, or in a comma;
* ``broken``: it ends in a mark put in place of the rest (an ellipsis fixed to what
  precedes it or in brackets), in half a character reference or tag, or in the
  character that stands for broken bytes.

Ends are counted only where none of these flags the text, and once more where the
trigram doesn't either: cut ends are no norm.
A missing source is a source of its own. Null, empty and blank texts are no cases;
white space at the end is ignored; repeated rows count each; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from kildespor.plans.shared import written
from kildespor.plans.skew import attach

LIFT, LEAN = 0.5, 5.0
#: A word is a class of its own when it is among the last four of so large a share of the texts, at least, and there in so large a share of its places; so there are at most 4 / NEAR_END of them.
NEAR_END, NEAR_END_SHARE = 0.001, 0.3

#: A source has a field limit when so many of its texts, at least, and so large a share are of its greatest length.
LEAST, CROWD = 4, 0.005

_TOKENS = r"\\p{N}+|[\\p{L}\\p{M}]+|\\n+|\\.{3,}|[^\\s\\p{L}\\p{M}\\p{N}]"
_WORD = r"^[\\p{L}\\p{M}]"

# explode(array(x)): a generated column is computed once, however often it is used
_TOKENISED = rf"""
SELECT id, source, text, chars, bytes, xxhash64(text) AS same, regexp_extract_all(text, '{_TOKENS}', 0) AS tokens
FROM (SELECT id, coalesce(nullif(lower(trim(source)), ''), '?') AS source, char_length(text) AS chars, octet_length(text) AS bytes,
  explode(array(regexp_replace(text, '(?U)\\s+\\z', ''))) AS text FROM @docs)
WHERE text <> ''
"""

_NEAR_END = rf"""
WITH last AS (
  SELECT word, count(*) AS near FROM (SELECT explode(array_distinct(slice(w, greatest(1, size(w) - 3), 4))) AS word
    FROM (SELECT filter(slice(tokens, -least(size(tokens), 12), 12), x -> x RLIKE '{_WORD}' AND length(x) > 1) AS w FROM @tokenised) WHERE size(w) > 0)
  GROUP BY word HAVING count(*) >= greatest(3, {NEAR_END} * @n)
), everywhere AS (
  SELECT /*+ BROADCAST(last) */ word, count(*) AS n FROM (SELECT explode(tokens) AS word FROM @tokenised) LEFT SEMI JOIN last USING (word) GROUP BY word
)
SELECT word FROM last JOIN everywhere USING (word) WHERE near >= {NEAR_END_SHARE} * n
"""

#: The first character decides; regular expressions are for what simple comparisons leave.
_CLASSED = r"""
SELECT id, source, text, chars, bytes, same, tokens, concat(array('^', '^'), transform(tokens, x -> CASE
  WHEN x IN (@near) THEN x WHEN lower(left(x, 1)) <> left(x, 1) THEN 'C' WHEN x BETWEEN 'a' AND '{' THEN 'w' WHEN x BETWEEN '0' AND ':' THEN '0'
  WHEN x < '\\n' THEN x WHEN x < ' ' THEN '/' WHEN x < 'a' THEN x
  WHEN x RLIKE '^\\p{Lu}' THEN 'C' WHEN x RLIKE '^[\\p{L}\\p{M}]' THEN 'w' WHEN x RLIKE '^\\p{N}' THEN '0' ELSE x END)) AS c
FROM @tokenised
"""

#: Trigrams of classes by source, and the class of their last token, as hashes.
_COUNTS = """
SELECT source, tri, one, CAST(count(*) AS DOUBLE) AS n FROM (
  SELECT source, inline(transform(sequence(3, size(c)), i -> struct(xxhash64(get(c, i - 3), get(c, i - 2), get(c, i - 1)) AS tri, xxhash64(get(c, i - 1)) AS one)))
  FROM (SELECT xxhash64(source) AS source, c FROM @classed))
GROUP BY source, tri, one
"""

_INSIDE = rf"""
SELECT DISTINCT explode(transform(filter(slice(tokens, 1, size(tokens) - 1), x -> x RLIKE '{_WORD}'), x -> lower(x))) AS word FROM @tokenised
"""

#: A word that starts with another follows it at once in their order, so the next inside word tells whether there is one.
_FRAGMENTS = rf"""
WITH finals AS (
  SELECT DISTINCT lower(element_at(tokens, -1)) AS word FROM @tokenised WHERE element_at(tokens, -1) RLIKE '{_WORD}'
), unseen AS (
  SELECT finals.word FROM finals LEFT ANTI JOIN @inside inside ON finals.word = inside.word
), ordered AS (
  SELECT word, asked, lead(CASE WHEN asked THEN NULL ELSE word END) IGNORE NULLS OVER (PARTITION BY left(word, 2) ORDER BY word) AS next
  FROM (SELECT word, true AS asked FROM unseen WHERE length(word) > 1 UNION ALL SELECT word, false FROM @inside WHERE length(word) > 1)
), beginnings AS (
  SELECT word FROM ordered WHERE asked AND startswith(next, word)
  UNION ALL SELECT word FROM unseen LEFT SEMI JOIN (SELECT DISTINCT left(word, 1) AS letter FROM @inside) ON word = letter
), thirds AS (
  SELECT third, count_if(last) AS ends, count(*) AS n FROM (
    SELECT inline(transform(sequence(1, length(word) - 2), i -> struct(substr(word, i, 3) AS third, i = length(word) - 2 AS last))) FROM @inside WHERE length(word) > 2)
  GROUP BY third
), odd AS (
  SELECT unseen.word FROM unseen LEFT JOIN thirds ON right(unseen.word, 3) = third WHERE length(unseen.word) > 2 AND coalesce(ends / n, 0) < 0.05
)
SELECT word FROM beginnings UNION SELECT word FROM odd
"""

_LIMITS = f"""
WITH most AS (SELECT source, count(*) AS texts, max(chars) AS most_chars, max(bytes) AS most_bytes FROM @tokenised GROUP BY source),
lengths AS (SELECT source, chars, bytes, count(*) AS n FROM @tokenised GROUP BY source, chars, bytes),
at_most AS (SELECT l.source, any_value(texts) AS texts, any_value(most_chars) AS most_chars, any_value(most_bytes) AS most_bytes,
  sum(if(chars = most_chars, n, 0)) AS by_chars, sum(if(bytes = most_bytes, n, 0)) AS by_bytes FROM lengths l JOIN most ON l.source = most.source GROUP BY l.source)
SELECT source, texts, if(by_chars >= greatest({LEAST}, {CROWD} * texts), most_chars, NULL) AS char_limit, if(by_bytes >= greatest({LEAST}, {CROWD} * texts), most_bytes, NULL) AS byte_limit FROM at_most
"""

_INSIDE = rf"""
SELECT DISTINCT explode(transform(filter(slice(tokens, 1, size(tokens) - 1), x -> x RLIKE '{_WORD}'), x -> lower(x))) AS word FROM @tokenised
"""

_FRAGMENTS = rf"""
WITH finals AS (
  SELECT DISTINCT lower(element_at(tokens, -1)) AS word FROM @tokenised WHERE element_at(tokens, -1) RLIKE '{_WORD}'
), unseen AS (
  SELECT finals.word FROM finals LEFT ANTI JOIN @inside inside ON finals.word = inside.word
), beginnings AS (
  SELECT DISTINCT unseen.word FROM unseen JOIN
    (SELECT explode(transform(sequence(1, length(word)), i -> left(word, i))) AS word FROM @inside) b ON unseen.word = b.word
), thirds AS (
  SELECT third, count_if(last) AS ends, count(*) AS n FROM (
    SELECT inline(transform(sequence(1, length(word) - 2), i -> struct(substr(word, i, 3) AS third, i = length(word) - 2 AS last))) FROM @inside WHERE length(word) > 2)
  GROUP BY third
), odd AS (
  SELECT unseen.word FROM unseen LEFT JOIN thirds ON right(unseen.word, 3) = third WHERE length(unseen.word) > 2 AND coalesce(ends / n, 0) < 0.05
)
SELECT word FROM beginnings UNION SELECT word FROM odd
"""

_BROKEN = "|".join([
    r"(?<=\\S)(?:\\.{3,}|…)",  # an ellipsis fixed to what precedes it
    r"[\\[(]\\s*(?:\\.{3,}|…)\\s*[\\])]",
    r"&#?[\\p{L}\\p{N}]{0,9}",
    r"<[/\\p{L}][^<>]{0,40}",
    r"\\uFFFD",
])
#: Whether what follows the last opening mark has no closing one.
_OPEN = " OR ".join(f"(contains(text, '{a}') AND NOT contains(substring_index(text, '{a}', -1), '{b}'))" for a, b in ("()", "[]", "»«"))

#: A full stop, question or exclamation mark with what may close after it.
_STOP = r"[.!?][\\p{Pe}\\p{Pf}\\p{Pi}\\x22\\x27]*"

_ENDS = rf"""
SELECT id, source, xxhash64(source) AS own, chars, bytes, same, xxhash64(element_at(c, -1)) AS final, xxhash64(get(c, size(c) - 3), get(c, size(c) - 2), get(c, size(c) - 1)) AS tri,
  xxhash64(lower(get(tokens, size(tokens) - 3)), lower(get(tokens, size(tokens) - 2)), lower(get(tokens, size(tokens) - 1))) AS words,
  right(text, 60) RLIKE '{_STOP}\\z' AS stopped, right(text, 60) RLIKE '(?:{_BROKEN})\\z' AS broken,
  element_at(tokens, -1) RLIKE '{_WORD}' AND ({_OPEN}) OR text LIKE '%,' AS open, CASE WHEN element_at(c, -1) = 'w' THEN lower(element_at(tokens, -1)) END AS word
FROM @classed
"""

_FLAGGED = """
SELECT *, broken OR open OR fragment OR at_limit AS cut FROM (
  SELECT e.id, e.source, e.own, e.same, e.tri, e.final, e.words, stopped, broken, open, f.word IS NOT NULL AS fragment,
    coalesce((chars = char_limit OR bytes = byte_limit) AND NOT stopped, false) AS at_limit
  FROM @ends e LEFT JOIN @fragments f ON e.word = f.word)
"""

#: Lifts by source and class trigram, each leaning on the next coarser one.
_LIFTS = f"""
WITH whole AS (
  SELECT own AS source, tri, final AS one, CAST(count(*) AS DOUBLE) AS ends FROM @flagged WHERE NOT cut GROUP BY own, tri, final
), both AS (
  SELECT c.source, c.tri, c.one, c.n, coalesce(w.ends, 0) AS ends FROM @counts c LEFT JOIN whole w ON c.source = w.source AND c.tri = w.tri AND c.one = w.one
), every AS (
  SELECT greatest(sum(ends), 1) / sum(n) AS base FROM both
), sources AS (
  SELECT source, (sum(ends) + {LEAN}) / (sum(n) + {LEAN} / first(base)) AS base FROM both, every GROUP BY source
), everywhere AS (
  SELECT one, (sum(ends) + {LEAN}) / (sum(n) * first(base) + {LEAN}) AS lift FROM both, every GROUP BY one
), finals AS (
  SELECT b.source, b.one, first(s.base) AS base, (sum(ends) + {LEAN} * first(e.lift)) / (sum(n) * first(s.base) + {LEAN}) AS lift
  FROM both b JOIN sources s ON b.source = s.source JOIN everywhere e ON b.one = e.one GROUP BY b.source, b.one
)
SELECT b.source AS own, b.tri, b.n AS rows, f.base, (b.ends + {LEAN} * f.lift) / (b.n * f.base + {LEAN}) AS lift
FROM both b JOIN finals f ON b.source = f.source AND b.one = f.one WHERE b.n > 0
"""

#: A bit for each final trigram of words, by its hash, in FILTER numbers of 64 bits: one row of fixed size.
FILTER = 65_536
_BITS = f"""
SELECT transform(array_sort(collect_list(struct(id, b))), x -> x.b) AS bits FROM (
  SELECT id, coalesce(b, 0) AS b FROM range({FILTER}) LEFT JOIN (
    SELECT shiftrightunsigned(words, 6) & {FILTER - 1} AS slot, bit_or(shiftleft(1L, CAST(words & 63 AS INT))) AS b FROM @flagged GROUP BY 1) ON id = slot)
"""

#: How often trigrams of words that end texts stand inside texts. Most others are left out by the bits before anything is shuffled, the rest by the join.
_INSIDE_TRIGRAMS = f"""
SELECT words, count(*) AS n FROM (
  SELECT explode(transform(sequence(3, size(t)), i -> xxhash64(get(t, i - 3), get(t, i - 2), get(t, i - 1)))) AS words
  FROM (SELECT explode(array(transform(slice(tokens, 1, size(tokens) - 1), x -> lower(x)))) AS t FROM @tokenised WHERE size(tokens) > 3))
LEFT SEMI JOIN (SELECT DISTINCT words FROM @flagged) USING (words)
WHERE getbit(get((SELECT first(bits) FROM @bits), CAST(shiftrightunsigned(words, 6) & {FILTER - 1} AS INT)), CAST(words & 63 AS INT)) = 1 GROUP BY words
"""

#: And how many different whole texts they end.
_WORDS = """
SELECT f.words, f.rows, f.ends AS w_ends, i.n AS w_n FROM (
  SELECT words, count(DISTINCT CASE WHEN NOT cut THEN same END) AS ends, count(*) AS rows FROM @flagged GROUP BY words) f
JOIN @inside i ON f.words = i.words
"""

_DECIDED = f"""
SELECT id, source, own, same, tri, final, words, stopped, broken, open, fragment, at_limit, trigram, cut OR trigram AS cut FROM (SELECT *,
  NOT stopped AND (greatest(coalesce(w_ends, 0) - if(cut, 0, 1), 0) + {LEAN} * lift) / (coalesce(w_n, 0) * base + {LEAN}) < {LIFT} AS trigram FROM @ends)
"""

#: Times that ends are judged; each time those found before are no norm any more.
TURNS = 2

#: The names of the rules, as columns of ``judged``.
RULES = ("trigram", "at_limit", "fragment", "open", "broken")


def _sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """query over tables, which it names as @name."""
    query = query.replace("{", "{{").replace("}", "}}")
    for name in tables:
        query = query.replace(f"@{name}", f"{{{name}}}")
    return spark.sql(query, **tables)


def judged(documents: DataFrame) -> DataFrame:
    """(id, source, RULES) of rows (id, source, text) with text; a text is truncated if any rule holds."""
    spark = documents.sparkSession
    tokenised = written(_sql(spark, _TOKENISED, docs=documents))
    near = _sql(spark, _NEAR_END.replace("@n)", f"{tokenised.count()})"), tokenised=tokenised)
    words = [r["word"] for r in near.orderBy("word").collect()]  # at most 4 / NEAR_END
    classed = written(_sql(spark, _CLASSED.replace("@near", ", ".join(f"'{w}'" for w in words) or "NULL"), tokenised=tokenised))
    counts = written(_sql(spark, _COUNTS, classed=classed))
    inside = written(_sql(spark, _INSIDE, tokenised=classed))
    fragments = _sql(spark, _FRAGMENTS, tokenised=classed, inside=inside)
    limits = written(_sql(spark, _LIMITS, tokenised=classed))
    ends = attach(written(_sql(spark, _ENDS, classed=classed)), limits, ["source"], "texts", "left").drop("texts")
    flagged = written(_sql(spark, _FLAGGED, ends=ends, fragments=fragments))
    bits = written(_sql(spark, _BITS, flagged=flagged))
    inside = written(_sql(spark, _INSIDE_TRIGRAMS, flagged=flagged, tokenised=classed, bits=bits))
    for _ in range(TURNS):
        lifts = written(_sql(spark, _LIFTS, counts=counts, flagged=flagged))
        seen = written(_sql(spark, _WORDS, flagged=flagged, inside=inside))
        ends = attach(flagged, lifts, ["own", "tri"], "rows").drop("rows", "trigram")
        ends = attach(written(ends), seen, ["words"], "rows", "left").drop("rows")
        flagged = written(_sql(spark, _DECIDED, ends=ends))
    return flagged.select("id", "source", *RULES)


def _hit():
    return reduce(lambda a, b: a | b, [F.col(r) for r in RULES])


def truncated(documents: DataFrame) -> DataFrame:
    """(id, source) of the truncated ones of rows (id, source, text)."""
    return judged(documents).where(_hit()).select("id", "source")


def rates(documents: DataFrame) -> DataFrame:
    """(source, texts, truncated, share, by_RULE) of every source; a missing one is '?'. A text may fall under several rules."""
    return judged(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(_hit()).alias("truncated"), F.round(F.avg(_hit().cast("double")), 6).alias("share"),
        *[F.count_if(F.col(r)).alias(f"by_{r}") for r in RULES],
    )
