"""Problems 3 and 5: defective answers and text that lost its end.

Both read the same judged pairs (source text, target text) of segments and translator traces. Judging a pair
needs no other row, so segments are judged where they lie; traces are joined to their segment once.

Lost ends come out by three kinds of evidence, kept apart in columns:

* `shortened` (method of problem 3): all answers are sorted by segment and text, over range partitions, and each is
  compared with its neighbour. Texts that open with a given text follow it directly in that order, so the next
  distinct text settles whether any longer version exists.
* `at_limit` (method of problem 5, and the length spikes of problem 3): discrete length hazards by window functions -
  of the values that reach a length, how many end there, all of them and those alone that end incomplete - in
  characters and in UTF-8 bytes, per source and over the whole table. Each is tested against the hazards of its
  neighbours, with the false discovery rate held in each family.
* neither: a transfer broke at a length of its own and no other answer goes on. No hazard or neighbour can show
  that, so the comparison of the ending with that of the source speaks alone. The rates report these apart.

An exact check follows the first two: the ending is more open than that of the source, or a whole-looking answer
has fewer sentences and clearly fewer characters than its pair of languages makes usual.

The language rules use word counts of the six languages, taken from source texts with the language of their
project: at most SAMPLE_TEXTS texts per language (chosen by hash), a bounded sample of labelled rows; every word
of the sample counts. Everything else counts all rows.

Defined results: null, blank, invisible and mark-only targets are `empty`; pairs whose source has no letter
or digit outside its marks give no row; a trace without its segment, a segment without its project and rows
with null ids give no row; repeated rows count once; a record has one defect, the first that holds of empty,
refusal, copy, wrong_language, truncated.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillmill.llm import textnorm
from quillmill.runtime import cut_lineage

SAMPLE_TEXTS = 6000
LANGUAGES = ("en", "fr", "es", "pt", "de", "ja")
#: Share of common words from which a target repeats its source.
COPY = 0.8
#: Half the number of neighbouring lengths that a hazard is tested against.
REACH = 5
FALSE_DISCOVERY = 0.001

# How models decline, in the languages of the projects.
_REFUSAL = re.compile(
    "|".join([
        r"(?:can'?t|cannot|can not|unable to|not able to|won'?t(?: be)?|will not(?: be)?|must decline|have to decline|refuse) .{0,40}?(?:translat|render|produc|provid|version|passage|segment|fulfil|assist with)",
        r"as an ai\b|(?:large )?language model\b|modelo de (?:lenguaje|linguagem)\b|modèle de langage\b|sprachmodell\b|言語モデル",
        r"(?:against|violat\w*|breach\w*) the content (?:rules|polic)", r"content polic(?:y|ies)",
        r"no (?:puedo|voy a|podré|me es posible) .{0,30}?(?:traduc|producir|versi)", r"debo (?:rehusar|rechazar|declinar)", r"(?:normas|reglas|políticas?) de contenido",
        r"não (?:posso|consigo|vou|me é possível) .{0,30}?(?:tradu|produzir|fornecer|vers)", r"tenho de recusar|devo recusar", r"(?:regras|normas|políticas?) de conteúdo",
        r"(?:il )?m'est impossible de .{0,30}?tradu", r"je dois (?:décliner|refuser)", r"je ne produirai pas", r"je ne (?:peux|puis) pas .{0,20}?(?:tradu|fournir)", r"règles de contenu",
        r"nicht übersetzen", r"übersetzung ist mir .{0,12}?nicht möglich", r"muss .{0,40}?ablehnen", r"werde ich nicht erstellen", r"gegen die inhaltsregeln|inhaltsrichtlinien",
        r"訳出は?.{0,6}(?:お断り|でき)", r"翻訳.{0,10}(?:できません|お断り|いたしかね)", r"訳文は?作成しません", r"(?:内容|コンテンツ).{0,8}(?:規則|規約|ポリシー)",
    ])
)
_SAID = re.compile(r"(?:said|dijo|disse|dit|sagte) \S|と.{1,60}言った")
_WORD = re.compile(r"[ぁ-ヿ㐀-鿿々]|[^\W\d_ぁ-ヿ㐀-鿿々]+")
_CJK = re.compile(r"[ぁ-ヿ㐀-鿿々]")
_SENTENCE = re.compile(r"(?<=[.!?。！？;|])\s*|\n")
_STOPS = re.compile(r"[.!?。！？]+")
_TAIL = re.compile(r"(?:\[\[/?T\d+\]\]|\s)+$")
_BROKEN_MARK = re.compile(r"\[\[?/?(?:T\d*)?\]?$")
#: What a cut leaves of marks and entities: no words of any language.
_DEBRIS = re.compile(r"\[{1,2}/?(?:t\d*)?\]?|/?t\d+\]{1,2}|&#?\w{0,6};?$", re.I)
_TERMINAL, _CLOSERS = ".!?。！？…", "\"'”’」』»)）]"


def _ending(text: str) -> tuple[int, str]:
    """(strength, last character): 3 ends a sentence, 2 a dash or other mark, 1 a mark that goes on, 0 a word; 4 trails off."""
    t = _TAIL.sub("", text)
    if not t:
        return 3, ""
    if t.endswith(("...", "…")):
        return 4, "…"
    if "[" in t[-8:] and _BROKEN_MARK.search(t):
        return 0, t[-1]
    c = t[-1]
    if c in _TERMINAL:
        return 3, c
    if c in _CLOSERS:
        before = t[:-1].rstrip(_CLOSERS)
        if c in "'’" and (not before or before[-1].isalnum()) and not re.search(r"\w{3,}['’]$", t):
            return 0, c
        if c in "\"" and (len(t) == 1 or t[-2].isspace()):
            return 0, c
        if c == "]" and not t.startswith("["):
            return 1, c
        return 3, c
    if c in "—–―":
        return 2, c
    if c.isalnum():
        return 0, c
    return (1, c) if c in ",;:|-/&\\([{¿¡«“‘「『、" else (2, c)


def cut_off(source: str, target: str) -> bool:
    """The target ends more openly than its source."""
    s, a = _ending(source)
    t, b = _ending(target)
    if t == 4:
        return s != 4
    return s != 4 and t < s and a != b or s == 4 and t <= 1


class Judge:
    """Rules on one pair; `words` maps a word to its log probabilities in the Latin-script languages."""

    def __init__(self, words: dict[str, list[float]]):
        self.words = words
        self.best = {w: max(range(5), key=v.__getitem__) for w, v in words.items()}

    def informative(self, tokens: list[str]) -> bool:
        """A word is known, or in Japanese script; single letters (3 x 52) are codes."""
        return any(len(t) > 1 and t in self.words or _CJK.match(t) for t in tokens)

    def off_language(self, text: str, tokens: list[str], lang: str) -> bool:
        if lang not in LANGUAGES:
            return False
        at = LANGUAGES.index(lang)
        known = [self.best[t] for t in tokens if t in self.best]
        cjk = sum(1 for t in tokens if _CJK.match(t))
        if lang != "ja" and not cjk and known and 2 * known.count(at) >= len(known):
            return False
        own = other = 0.0
        for part in _SENTENCE.split(text):
            toks = _WORD.findall(part)
            score, n, j = [0.0] * 5, 0, 0
            for t in toks:
                v = self.words.get(t)
                if v is not None:
                    n += 1
                    for k in range(5):
                        score[k] += v[k]
                elif _CJK.match(t):
                    j += 1
            if j >= 2 and j > n:
                weight, mine = j / 2, lang == "ja"
            elif n:
                top = max(score)
                weight, mine = n, lang != "ja" and score[at] >= top - 3.0
            else:
                continue
            if mine:
                own += weight
            else:
                other += weight
        return other > own and other >= 2

    def __call__(self, source: str, target: str | None, lang: str | None, source_is: str | None) -> tuple | None:
        """(defect or None, open, sentences of source, of target, visible lengths of both), or None where the source makes no case."""
        src = textnorm.repair_characters(source)
        if not textnorm.has_content(src):
            return None
        tgt = textnorm.repair_characters(target) if target is not None else ""
        bare = textnorm.MARK.sub("", tgt).strip()
        if not bare:
            return "empty", False, 0, 0, 0, 0
        plain = textnorm.MARK.sub("", src).strip()
        low = bare.lower()
        if _REFUSAL.search(low) and not _SAID.search(low) and not _REFUSAL.search(plain.lower()):
            return "refusal", False, 0, 0, 0, 0
        if not any(c.isalnum() for c in bare):
            return "empty", False, 0, 0, 0, 0
        stoks, ttoks = _WORD.findall(plain.lower()), _WORD.findall(low)
        total = len(stoks) + len(ttoks)
        if total and source_is != lang and 2 * min(len(stoks), len(ttoks)) >= COPY * total:
            if stoks == ttoks:
                share = 1.0
            else:
                share = 2 * sum((Counter(stoks) & Counter(ttoks)).values()) / total
            if share >= COPY and self.informative(stoks):
                return "copy", False, 0, 0, 0, 0
        told = _DEBRIS.sub(" ", low) if "[" in low or "]" in low or "&" in low else low
        if lang and self.off_language(told, ttoks if told is low else _WORD.findall(told), lang):
            return "wrong_language", False, 0, 0, 0, 0
        return None, cut_off(src, tgt), len(_STOPS.findall(plain)), len(_STOPS.findall(bare)), len(plain), len(bare)


def word_model(segments: DataFrame, projects: DataFrame) -> dict[str, list[float]]:
    """Log probabilities of words written in lower case, per Latin-script language, from a bounded sample of source texts."""
    labelled = segments.select("id", "project_id", "source_text").join(projects.select(F.col("id").alias("project_id"), "source_lang"), "project_id")
    labelled = labelled.where(F.col("source_lang").isin(*LANGUAGES[:5]))
    sizes = labelled.groupBy("source_lang").agg(F.approx_count_distinct("id").alias("n"))
    text = F.regexp_replace("source_text", r"\[\[/?T\d+\]\]", " ")
    counts = (
        labelled.join(F.broadcast(sizes), "source_lang")  # a row per language of LANGUAGES
        .where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= F.lit(1_000_003 * SAMPLE_TEXTS) / F.col("n"))
        .select("source_lang", F.explode(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{M}])(\p{Ll}[\p{L}\p{M}]*)"), 1)).alias("word"))
        .groupBy("source_lang", "word").count()
        .groupBy("word").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("source_lang", "count"))).alias("by"))
        .where("n >= 3").collect()
    )
    totals = Counter()
    for r in counts:
        totals.update(r["by"])
    out = {}
    for r in counts:
        p = [(r["by"].get(lang, 0) + 0.05) / (totals[lang] + 1) for lang in LANGUAGES[:5]]
        s = sum(p)
        out[r["word"]] = [math.log(x / s + 1e-4) for x in p]
    return out


def pairs(segments: DataFrame, traces: DataFrame, projects: DataFrame) -> DataFrame:
    """(table_name, record_id, owner, segment_id, source, target, source_lang, target_lang) of all records with an answer."""
    p = projects.select(F.col("id").alias("project_id"), "source_lang", "target_lang")
    own = segments.where("status IS NULL OR status <> 'pending'").where("id IS NOT NULL AND source_text IS NOT NULL").select(
        F.lit("segment").alias("table_name"), F.col("id").alias("record_id"), F.col("project_id").alias("owner"),
        F.col("id").alias("segment_id"), F.col("source_text").alias("source"), F.col("target_text").alias("target"), "project_id",
    )
    text = segments.where("source_text IS NOT NULL").select(F.col("id").alias("segment_id"), F.col("source_text").alias("source"), "project_id")
    said = (
        traces.where("id IS NOT NULL").select(F.col("id").alias("record_id"), F.col("model").alias("owner"), "segment_id", "target")
        .join(text, "segment_id")
        .select(F.lit("translator_trace").alias("table_name"), "record_id", "owner", "segment_id", "source", "target", "project_id")
    )
    return own.unionByName(said).join(p, "project_id").drop("project_id")


JUDGED = (
    "table_name string, record_id string, owner string, segment_id string, text string, defect string, open boolean, "
    "source_stops int, target_stops int, source_chars int, target_chars int, length int, bytes int, pair string"
)


def judge(rows: DataFrame, words: dict[str, list[float]]) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule = Judge(shared.value)
        cols = ["defect", "open", "source_stops", "target_stops", "source_chars", "target_chars"]
        code = lambda x: x if x in LANGUAGES else "?"
        for pdf in batches:
            got = [rule(s, t, lang, own) for s, t, lang, own in zip(pdf["source"], pdf["target"], pdf["target_lang"], pdf["source_lang"])]
            kept = [k for k, g in enumerate(got) if g is not None]
            out = pdf.iloc[kept][["table_name", "record_id", "owner", "segment_id"]].reset_index(drop=True)
            for c, values in zip(cols, zip(*(got[k] for k in kept)) if kept else [[] for _ in cols]):
                out[c] = values
            said = [t if t is not None else "" for t in pdf["target"].iloc[kept]]
            out["text"] = [t.rstrip() for t in said]
            out["length"] = [len(t) for t in said]
            out["bytes"] = [len(t.encode("utf-8", "surrogatepass")) for t in said]
            out["pair"] = [f"{code(a)}>{code(b)}" for a, b in zip(pdf["source_lang"].iloc[kept], pdf["target_lang"].iloc[kept])]
            yield out

    return rows.mapInPandas(run, JUDGED)


FAMILY = ["table_name", "owner", "unit", "cause"]


def length_hazards(ends: DataFrame) -> DataFrame:
    """ends(table_name, owner, unit, cause, length, n, ending) -> the same rows with their hazard and its test.

    `n` values have the length and `ending` of them count as ends of that cause. Added are reaching (values at least so
    long), hazard, expected (from the neighbouring lengths), p_value, and significant, decided per family.
    """
    per = W.partitionBy(*FAMILY)
    desc = per.orderBy(F.desc("length")).rangeBetween(W.unboundedPreceding, 0)
    near = per.orderBy("length").rangeBetween(-REACH, REACH)
    h = ends.withColumn("reaching", F.sum("n").over(desc)).withColumn("around", F.sum("ending").over(near) - F.col("ending"))
    h = h.withColumn("hazard", F.col("ending") / F.col("reaching")).withColumn("expected", F.least(F.lit(0.999), (F.col("around") + 1.0) / (2 * REACH * F.col("reaching"))))
    # the tail of a binomial is bounded by exp(-N * KL(observed, expected))
    kl = F.col("hazard") * F.log(F.col("hazard") / F.col("expected")) + F.when(F.col("hazard") < 1, (1 - F.col("hazard")) * F.log((1 - F.col("hazard")) / (1 - F.col("expected")))).otherwise(0.0)
    h = h.withColumn("p_value", F.when(F.col("hazard") > F.col("expected"), F.exp(-F.col("reaching") * kl)).otherwise(F.lit(1.0)))
    h = h.withColumn("_rank", F.row_number().over(per.orderBy("p_value", "length"))).withColumn("_tests", F.count("*").over(per))
    passed = F.when(F.col("p_value") <= FALSE_DISCOVERY * F.col("_rank") / F.col("_tests"), F.col("p_value"))
    h = h.withColumn("_last", F.max(passed).over(per)).withColumn("significant", F.coalesce(F.col("p_value") <= F.col("_last"), F.lit(False)))
    return h.select(*FAMILY, "length", "n", "ending", "reaching", "hazard", "expected", "p_value", "significant")


def ends_by_length(judged: DataFrame) -> DataFrame:
    """Counts for `length_hazards`: in characters and bytes, all ends and incomplete ones, per owner and (owner null) per table."""
    once = judged.where("length > 0").groupBy("table_name", "record_id").agg(F.min(F.struct("owner", "length", "bytes", F.coalesce(F.col("defect").isNull() & F.col("open"), F.lit(False)).alias("open"))).alias("r"))
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("r.length").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("r.bytes").alias("length"))))
    # counts per owner first; all that follows sees a row per owner and length
    own = (
        once.select("table_name", F.col("r.owner").alias("owner"), F.col("r.open").alias("open"), units.alias("u"))
        .groupBy("table_name", F.coalesce("owner", F.lit("")).alias("owner"), "u.unit", "u.length").agg(F.count("*").alias("n"), F.count_if("open").alias("incomplete"))
    )
    pooled = own.groupBy("table_name", F.lit(None).cast("string").alias("owner"), "unit", "length").agg(F.sum("n").alias("n"), F.sum("incomplete").alias("incomplete"))
    causes = F.explode(F.array(F.struct(F.lit("any").alias("cause"), F.col("n").alias("ending")), F.struct(F.lit("incomplete").alias("cause"), F.col("incomplete").alias("ending"))))
    return own.unionByName(pooled).select("table_name", "owner", "unit", "length", "n", causes.alias("c")).select("table_name", "owner", "unit", "c.cause", "length", "n", "c.ending")


def longer_versions(answers: DataFrame) -> DataFrame:
    """answers(segment_id, text) -> the distinct ones that open another answer of their segment.

    Sorted by segment and text over range partitions, so no segment is gathered in one task however often it is
    answered; the last row of each run looks at the first of the next (a row per run).
    """
    texts = answers.where("text <> ''").select("segment_id", "text").distinct()
    several = texts.groupBy("segment_id").count().where("count > 1").select("segment_id")
    runs = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(texts.join(several, "segment_id", "left_semi").repartitionByRange(runs, "segment_id", "text").withColumn("run", F.spark_partition_id()))
    row = F.struct("segment_id", "text")
    firsts = ranged.groupBy("run").agg(F.min(row).alias("after"))
    following = firsts.select(F.lag("run").over(W.orderBy("run")).alias("run"), "after").where("run IS NOT NULL")
    sorted_rows = ranged.withColumn("next", F.lead(row).over(W.partitionBy("run").orderBy("segment_id", "text"))).join(F.broadcast(following), "run", "left")  # a row per run
    nxt = F.coalesce("next", "after")
    return sorted_rows.where((nxt["segment_id"] == F.col("segment_id")) & nxt["text"].startswith(F.col("text"))).select("segment_id", "text")


def lost_ends(judged: DataFrame) -> DataFrame:
    """(table_name, record_id, owner, at_limit, shortened) of every record whose target is cut off."""
    # a row per pair of LANGUAGES
    usual = (
        judged.where("defect IS NULL AND NOT open AND source_chars > 30")
        .groupBy("pair").agg(F.percentile_approx(F.col("target_chars") / F.col("source_chars"), 0.5).alias("usual"))
    )
    candidates = cut_lineage(
        judged.where("defect IS NULL AND (open OR target_stops < source_stops)").join(F.broadcast(usual), "pair", "left")
        .where(F.col("open") | F.coalesce(F.expr("target_chars < 0.9 * usual * source_chars"), F.lit(False)))
        .select("table_name", "record_id", F.coalesce("owner", F.lit("")).alias("owner"), "segment_id", "text", "open", "length", "bytes")
    )
    limits = cut_lineage(length_hazards(ends_by_length(judged)).where("significant").select("table_name", "owner", "unit", "length").distinct())
    sized = candidates.select("table_name", "record_id", "owner", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u")).select("table_name", "record_id", "owner", "u.*")
    key = ["table_name", "unit", "length"]
    limited = (
        sized.join(limits.where("owner IS NOT NULL"), [*key, "owner"], "left_semi")
        .unionByName(sized.join(limits.where("owner IS NULL").select(*key), key, "left_semi"))
        .select("table_name", "record_id").distinct().withColumn("at_limit", F.lit(True))
    )
    longer = longer_versions(judged.select("segment_id", "text")).withColumn("shortened", F.lit(True))
    seen = candidates.join(longer, ["segment_id", "text"], "left").join(limited, ["table_name", "record_id"], "left")
    return (
        seen.where("open OR shortened OR at_limit").groupBy("table_name", "record_id")
        .agg(F.min("owner").alias("owner"), F.coalesce(F.bool_or("at_limit"), F.lit(False)).alias("at_limit"), F.coalesce(F.bool_or("shortened"), F.lit(False)).alias("shortened"))
    )


def judged_records(segments: DataFrame, traces: DataFrame, projects: DataFrame) -> DataFrame:
    return cut_lineage(judge(pairs(segments, traces, projects), word_model(segments, projects)))


def defects(segments: DataFrame, traces: DataFrame, projects: DataFrame) -> DataFrame:
    """Problem 3: (table_name, record_id, defect), one row for each defective record."""
    judged = judged_records(segments, traces, projects)
    found = judged.where("defect IS NOT NULL").groupBy("table_name", "record_id").agg(F.min("defect").alias("defect"))
    return found.unionByName(lost_ends(judged).select("table_name", "record_id", F.lit("truncated").alias("defect")))


def truncated(segments: DataFrame, traces: DataFrame, projects: DataFrame) -> DataFrame:
    """Problem 5: the rows of `lost_ends`."""
    return lost_ends(judged_records(segments, traces, projects))


def truncation_rates(segments: DataFrame, traces: DataFrame, projects: DataFrame) -> DataFrame:
    """(table_name, owner, records, truncated, at_limit, shortened, by_ending, share): how often each project or model loses ends.

    `by_ending` counts those with neither a significant length nor a longer version: the ending alone speaks.
    """
    lost = truncated(segments, traces, projects).groupBy("table_name", "owner").agg(
        F.count("*").alias("truncated"), F.count_if("at_limit").alias("at_limit"), F.count_if("shortened").alias("shortened"), F.count_if(~F.col("at_limit") & ~F.col("shortened")).alias("by_ending"))
    all_rows = (
        segments.where("(status IS NULL OR status <> 'pending') AND id IS NOT NULL").select(F.lit("segment").alias("table_name"), F.coalesce("project_id", F.lit("")).alias("owner"), "id")
        .unionByName(traces.where("id IS NOT NULL").select(F.lit("translator_trace").alias("table_name"), F.coalesce("model", F.lit("")).alias("owner"), "id"))
        .distinct().groupBy("table_name", "owner").agg(F.count("*").alias("records"))
    )
    counts = ["truncated", "at_limit", "shortened", "by_ending"]
    return (
        all_rows.join(lost, ["table_name", "owner"], "left")
        .select("table_name", "owner", "records", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
        .withColumn("share", F.round(F.col("truncated") / F.col("records"), 6))
    )
