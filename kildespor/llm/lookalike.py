r"""One consistent form of texts that look the same and differ in characters.

Method: script-aware repair. What is invisible goes, white space becomes one
blank, width and font variants, ligatures and decomposed accents become the
usual characters. Then the dominant script of each token is determined: of the
scripts of its letters and the text's own, the one with most letters that none of
the others has a look-alike of, then the text's own, then the one with most
letters. Letters of other scripts are replaced by the dominant script's
look-alikes, whatever scripts these are, and only when the result is in the
vocabulary of the corpus: a token of another text as it is, or what another token
becomes. So a word that is disguised as a whole is found too. A text's script is
that of most of its letters, or MAIN where every letter is of MAIN or looks like one.

Which letters look alike is taken from the Unicode confusables data in the ICU
library that Spark's own distribution holds. Upper and lower case, accents,
digits and punctuation marks stay apart, so a superscript or a curly quote is no
other character's variant. Letters without case look like those of either.

Null texts have a null form, blank ones an empty one; neither has a partner.
Texts of any length are taken whole; repeated rows count each; extra columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from kildespor.plans.shared import written
from kildespor.plans.skew import attach

#: Texts of only these characters need nothing but their white space made even; the micro sign and U+2011 are folded to others.
PLAIN = r"\A[\x20-\x7E\xA1-\xAC\xAE-\xB4\xB6-\xFF‐‒-―‘-‟†-•…]*\z"
#: The script of texts whose every letter can be read as one of it.
MAIN = "LATIN"
#: Letters that others of their own script stand for: those of the usual ranges.
_USUAL = {"LATIN": 0x100, "CYRILLIC": 0x460, "GREEK": 0x3D0}
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]|(?!\s)\p{Cc}")
_PAIRS = pa.list_(pa.struct([("suspect", pa.string()), ("repaired", pa.string())]))
_PAIRS_SQL = "array<struct<suspect:string,repaired:string>>"
_FOLDED = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def script(c: str) -> str:
    """The script in a letter's name."""
    return unicodedata.name(c, "?").partition(" ")[0]


def _letters() -> list[str]:
    """Letters of alphabets and syllabaries, without those of width or font variants, which are folded before."""
    many = ("CJK", "HANGUL", "MATHEMATICAL", "FULLWIDTH", "HALFWIDTH", "MODIFIER", "SUPERSCRIPT", "EGYPTIAN", "CUNEIFORM", "TANGUT", "NUSHU", "?")
    return [c for c in map(chr, range(0x41, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and script(c) not in many]


def look_alikes(spark: SparkSession) -> dict[str, dict[str, str]]:
    """For each script the letters that look like one of its own, of the same case, and that one."""
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except Exception as why:
        raise RuntimeError("the ICU library (icu4j), which Spark's distribution holds, isn't on the class path") from why
    letters = _letters()
    shapes: dict[str, list[str]] = {}
    for c, shape in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")):
        shapes.setdefault(shape, []).append(c)
    out: dict[str, dict[str, str]] = {}
    for alike in shapes.values():
        if len(alike) < 2:
            continue
        own: dict[tuple[str, str], str] = {}
        for c in alike:  # by code point
            s = script(c)
            if ord(c) < _USUAL.get(s, sys.maxunicode):
                own.setdefault((s, unicodedata.category(c)), c)
        for (s, kind), target in own.items():
            for c in alike:
                if c != target and unicodedata.category(c) in (kind, "Lo"):
                    if script(c) == s and ord(c) < _USUAL.get(s, sys.maxunicode):
                        continue  # another usual letter of the script
                    out.setdefault(s, {}).setdefault(c, target)
    return out


def _usual(c: str) -> str:
    tag = unicodedata.decomposition(c).partition(" ")[0]
    if tag in _FOLDED or tag == "<compat>" and unicodedata.category(c)[0] in "LN":
        return unicodedata.normalize("NFKC", c)
    return c


def _composed(text: str) -> str:
    """Letters and their marks as one character; a stroke through an o has no canonical composition."""
    text = regex.sub("([oO])[\u0337\u0338]", lambda m: "ø" if m[1] == "o" else "Ø", text)
    return unicodedata.normalize("NFC", text)


def folded(text: str) -> str:
    text = _INVISIBLE.sub("", text)
    return " ".join(_composed("".join(c if c < "\x7f" else _usual(c) for c in text)).split())


def repaired(token: str, own: str, alike: dict[str, dict[str, str]]) -> str | None:
    """The token in its dominant script, or None where nothing is to be replaced or a letter has no look-alike there. own: the text's script."""
    letters = [c for c in token if c.isalpha()]
    count = Counter(map(script, letters))
    if not count:
        return None
    scripts = {*count, own}
    distinct = Counter(script(c) for c in letters if not any(c in alike.get(s, ()) for s in scripts if s != script(c)))
    target = max(scripts, key=lambda s: (distinct[s], s == own, count[s], s))
    table = alike.get(target, {})
    changed = []
    for c in token:
        if c in table:
            c = table[c]
        elif c.isalpha() and script(c) != target:
            return None
        changed.append(c)
    out = _composed("".join(changed))
    return out if out != token else None


def text_script(text: str, alike: dict[str, dict[str, str]], main: str = MAIN) -> str:
    """The script of most letters, or ``main`` where each letter is of it or looks like one of it."""
    count = Counter(c for c in text if c.isalpha())
    scripts: Counter = Counter()
    for c, n in count.items():
        scripts[script(c)] += n
    if all(c in alike.get(main, ()) for c in count if script(c) != main):
        return main
    return max(scripts, key=lambda s: (scripts[s], s == main, s))


def _suspects(alike: dict[str, dict[str, str]], main: str):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            forms = [folded(t) for t in batch.column("text").to_pylist()]
            tokens = []
            if len(known) > 100_000:
                known.clear()
            for f in forms:
                found = {}
                own = text_script(f, alike, main)
                for t in _TOKEN.findall(f):
                    if t.isascii() and own == "LATIN":
                        continue
                    if (t, own) not in known:
                        known[t, own] = repaired(t, own, alike)
                    if known[t, own]:
                        found[t] = known[t, own]
                tokens.append([{"suspect": k, "repaired": v} for k, v in sorted(found.items())])
            arrays = [*[batch.column(c) for c in ("tbl", "id", "text")], pa.array(forms, pa.string()), pa.array(tokens, _PAIRS)]
            yield pa.RecordBatch.from_arrays(arrays, ["tbl", "id", "text", "form", "suspects"])

    return fold


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = []
        for form, pairs in zip(batch.column("form").to_pylist(), batch.column("repairs").to_pylist()):
            by = {p["suspect"]: p["repaired"] for p in pairs or []}
            forms.append(_TOKEN.sub(lambda m: by.get(m[0], m[0]), form))
        kept = [batch.column(c) for c in ("tbl", "id", "text")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(forms, pa.string()), batch.column("rows")], ["tbl", "id", "text", "form", "rows"])


def consistent(texts: DataFrame, main: str = MAIN) -> DataFrame:
    """(tbl, id, text, form) of rows (tbl, id, text)."""
    spark = texts.sparkSession
    alike = look_alikes(spark)
    kinds = f"tbl string, id {texts.schema['id'].dataType.simpleString()}, text string, form string"
    rows = texts.select("tbl", "id", "text")
    plain = F.col("text").rlike(PLAIN)
    even = rows.where("text is null").select("*", F.lit(None).cast("string").alias("form")).unionByName(
        rows.where(plain).select("*", F.trim(F.regexp_replace("text", " +", " ")).alias("form"))
    )
    odd = rows.where(~plain).mapInArrow(_suspects(alike, main), f"{kinds}, suspects {_PAIRS_SQL}")
    forms = written(even.withColumn("suspects", F.array().cast(_PAIRS_SQL)).unionByName(odd))
    some = forms.where(F.size("suspects") > 0)
    pairs = written(some.select(F.inline("suspects")).groupBy("suspect", "repaired").agg(F.count(F.lit(1)).alias("n")).withColumn("word", F.lower("repaired")))
    words = forms.select(F.explode(F.regexp_extract_all(F.lower("form"), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))).alias("word")).distinct()
    supported = pairs.groupBy("word").agg(F.count_distinct(F.lower("suspect")).alias("k")).where("k > 1").select("word")
    vocabulary = words.join(pairs.select("word").distinct(), "word", "left_semi").unionByName(supported).distinct()
    repairs = written(pairs.join(vocabulary, "word", "left_semi").select("suspect", "repaired", "n"))
    asked = some.select("tbl", "id", "text", "form", F.size("suspects").alias("size"), F.inline("suspects"))
    per_row = (
        attach(asked, repairs, ["suspect", "repaired"], "n", "left")
        .groupBy("tbl", "id", "text", "form")
        .agg(
            F.collect_set(F.when(F.col("n").isNotNull(), F.struct("suspect", "repaired"))).alias("repairs"),
            F.count(F.lit(1)).alias("m"), F.max("size").alias("size"),
        )
        .select("tbl", "id", "text", "form", "repairs", (F.col("m") / F.col("size")).cast("bigint").alias("rows"))  # equal rows are one here
    )
    mended = per_row.mapInArrow(_repaired, f"{kinds}, rows bigint").select("tbl", "id", "text", "form", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return forms.where(F.size("suspects") == 0).select("tbl", "id", "text", "form").unionByName(mended.select("tbl", "id", "text", "form"))


def same_to_the_reader(forms: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): rows of one form and of different texts, the smaller id first.

    Distinct texts of a form are paired before rows are, so equal texts, however
    many, are never compared with one another. Texts and forms are told apart by
    128 bits of hash, so only these are shuffled.
    """
    two = lambda c: F.concat(F.hex(F.xxhash64(c)), F.lit(" "), F.hex(F.xxhash64(F.lit("\u0001"), c)))
    rows = written(forms.where("form <> ''").select("tbl", "id", two("form").alias("form"), two("text").alias("h")))
    several = rows.groupBy("tbl", "form").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    kept = written(attach(rows, written(several.select("tbl", "form", "n")), ["tbl", "form"], "n", "left_semi"))
    kinds = kept.select("tbl", "form", "h").distinct()
    pairs = kinds.withColumnRenamed("h", "h_a").join(kinds.withColumnRenamed("h", "h_b"), ["tbl", "form"]).where("h_a < h_b")
    left = kept.select("tbl", "form", F.col("h").alias("h_a"), F.col("id").alias("a"))
    right = kept.select("tbl", "form", F.col("h").alias("h_b"), F.col("id").alias("b"))
    return (
        pairs.join(left, ["tbl", "form", "h_a"])
        .join(right, ["tbl", "form", "h_b"])
        .where("a <> b")
        .select("tbl", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        .distinct()
    )
