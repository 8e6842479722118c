"""Captions to chunks: parsing, roll-up removal, clipping, sliding windows, sentence sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgrid.functions.columns import clean_lines, clock_seconds, ends_sentence, seconds_clock, token_count

WINDOW_SEC, STRIDE_SEC, MAX_TOKENS, SNAP_WORDS = 30, 25, 512, 12
#: Prefixes of header blocks.
HEADERS = ("WEBVTT", "Kind:", "Language:", "NOTE")
#: Fixed value: a time line, with its two clocks as groups.
STAMP = r"^(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})"
#: Fixed value: what caption texts put for sounds that are no speech.
NO_SPEECH = r"(?i)\[(music|inaudible|applause|laughter|silence|crosstalk)\]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"


def parse_captions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cues of WebVTT texts: id, cue_no, start_sec, end_sec, lines.

    A new cue begins at every time line, and ``cue_no`` is the number of its time line from 0.  Header
    blocks and what stands before a time line are dropped; lines are cleaned, blank ones removed, and a
    cue without any line is none.  Everything happens inside the row's own array, so a text never leaves
    its task.  Null texts have no cues.
    """
    rows = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(F.split(F.col(text_col), LINE_BREAK), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")).alias("l"))
    header = F.lit(False)
    kind = lambda x: F.when(x.rlike(STAMP), 1).when(reduce(lambda c, h: c | x.startswith(h), HEADERS, header), 2).otherwise(0)
    # one pass over the lines leaves the boundaries; a cue holds the lines up to the next one
    marks = F.filter(F.transform("l", lambda x, i: F.struct(kind(x).alias("k"), i.alias("i"))), lambda m: m["k"] > 0)
    ends = F.transform("at", lambda m, j: F.struct(m["k"].alias("k"), m["i"].alias("i"), F.coalesce(F.get("at", j + 1)["i"], F.size("l")).alias("to")))
    cues = rows.withColumn("at", marks).select("id", "l", F.posexplode(F.filter(ends, lambda m: m["k"] == 1)).alias("cue_no", "m"))
    head = F.get("l", F.col("m.i"))
    body = F.filter(clean_lines(F.slice("l", F.col("m.i") + 2, F.greatest(F.col("m.to") - F.col("m.i") - 1, F.lit(0)))), lambda x: x != "")
    out = cues.select("id", "cue_no", clock_seconds(F.regexp_extract(head, STAMP, 1)).alias("start_sec"), clock_seconds(F.regexp_extract(head, STAMP, 2)).alias("end_sec"), body.alias("lines"))
    return out.filter(F.size("lines") > 0)


def settle_rollup(cues: DataFrame) -> DataFrame:
    """Cues without the leading lines that repeat the last line of the cue before.

    A cue of repeated lines only stays as a span without lines, so windows begin and end where they did.
    """
    prev = F.lag(F.element_at("lines", -1)).over(W.partitionBy("id").orderBy("cue_no"))
    full = cues.withColumn("tail", prev)
    lead = F.size(F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.forall(F.slice("lines", F.lit(1), i), lambda x: x == F.col("tail"))))
    kept = F.when(F.col("tail").isNull(), F.col("lines")).otherwise(F.slice("lines", lead + 1, F.greatest(F.size("lines") - lead, F.lit(0))))
    return full.withColumn("lines", kept).drop("tail")


def drop_rollup(cues: DataFrame) -> DataFrame:
    """Cues without the leading lines that repeat the last line of the cue before; empty cues go."""
    return settle_rollup(cues).filter(F.size("lines") > 0)


def clip_cues(cues: DataFrame, start: float, end: float) -> DataFrame:
    """Cues inside ``[start, end)``, cut to it and rebased to 0."""
    if end <= start:
        raise ValueError("end must lie after start")
    inside = cues.filter((F.col("end_sec") > start) & (F.col("start_sec") < end))
    return inside.withColumn("start_sec", F.greatest(F.col("start_sec"), F.lit(float(start))) - start).withColumn("end_sec", F.least(F.col("end_sec"), F.lit(float(end))) - start)


def _last_end(words: Column) -> Column:
    """Number of the last word that ends a sentence, from 1; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(words, lambda x, i: F.when(x.rlike(r"[.!?]$"), i + 1))), F.lit(0))


def fixed_windows(cues: DataFrame, window: int = WINDOW_SEC, stride: int = STRIDE_SEC, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Sliding windows over cue midpoints: id, window_no, start_sec, end_sec, text, token_count.

    The windows of a cue follow from its midpoint in closed form, so the join with windows is an
    explode of at most ``ceil(window / stride)`` rows.  Times are those of the first and last cue in file
    order, with or without lines; a window without words is none.  A text that ends inside a sentence is
    trimmed to its last sentence end when that takes at most ``SNAP_WORDS`` words.  Texts over ``max_tokens``
    words are cut there, or at a sentence end in the last tenth of their characters.
    """
    if stride <= 0 or stride > window:
        raise ValueError("need 0 < stride <= window")
    mid = (F.col("start_sec") + F.col("end_sec")) / 2
    last = F.floor(mid / stride)
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((mid - window) / stride) + 1)
    placed = cues.select("id", "cue_no", "start_sec", "end_sec", F.array_join("lines", " ").alias("t"), F.explode(F.sequence(first, last)).alias("window_no"))
    win = placed.groupBy("id", "window_no").agg(
        F.array_sort(F.collect_list(F.struct("cue_no", "t"))).alias("c"), F.min_by("start_sec", "cue_no").alias("start_sec"), F.max_by("end_sec", "cue_no").alias("end_sec")
    )
    toks = F.filter(F.split(F.trim(F.array_join(F.transform("c", lambda x: x["t"]), " ")), r"\s+"), lambda x: x != "")
    out = win.select("id", "window_no", "start_sec", "end_sec", toks.alias("w")).filter("size(w) > 0")
    out = out.withColumn("end", _last_end(F.col("w")))
    snap = (F.col("end") > 0) & (F.size("w") - F.col("end") <= SNAP_WORDS)
    out = out.withColumn("w", F.when(snap, F.slice("w", 1, F.col("end"))).otherwise(F.col("w"))).withColumn("cut", F.slice("w", 1, max_tokens))
    out = out.withColumn("end", _last_end(F.col("cut")))
    late = F.length(F.array_join(F.slice("cut", 1, F.col("end")), " ")) >= F.floor(F.length(F.array_join("cut", " ")) * 0.9)
    out = out.withColumn("n", F.when((F.size("w") > max_tokens) & (F.col("end") > 0) & late, F.col("end")).otherwise(F.size("cut")))
    return out.select("id", "window_no", "start_sec", "end_sec", F.array_join(F.slice("cut", 1, F.col("n")), " ").alias("text"), F.col("n").alias("token_count"))


def sentence_sessions(cues: DataFrame, target: float = 30.0, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Chunks that close at a sentence end once ``target`` seconds long, or at ``max_tokens`` words.

    A closing cue may carry a chunk over ``max_tokens``; its text is cut there.

    Whether a cue closes depends on where the chunk began, so each text's cues are folded in order by one
    ``aggregate`` expression in its row; the remainder is a chunk as well.
    """
    line = F.array_join("lines", " ")
    one = cues.filter("size(lines) > 0").select("id", F.struct("cue_no", "start_sec", "end_sec", line.alias("t"), token_count(line).alias("n"), ends_sentence(line).alias("ends")).alias("c"))
    per = one.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    # the fold carries numbers only: where the chunk began, its words, the position, and the chunks so far
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("s"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"))

    def step(acc, x):
        begun, n, i = F.coalesce(acc["s"], x["start_sec"]), acc["n"] + x["n"], acc["i"] + 1
        close = ((x["end_sec"] - begun >= target) & x["ends"]) | (n >= max_tokens)
        cuts = F.when(close, F.concat(acc["cuts"], F.array(i))).otherwise(acc["cuts"])
        return F.struct(F.when(close, none).otherwise(begun).alias("s"), F.when(close, 0).otherwise(n).alias("n"), i.alias("i"), cuts.alias("cuts"))

    # a last open chunk ends at the last cue
    def finish(acc):
        return F.when(acc["s"].isNull(), acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(acc["i"])))

    folded = per.withColumn("cuts", F.aggregate("c", start, step, finish)).select("id", "c", "cuts", F.posexplode("cuts").alias("chunk_no", "to"))
    begin = F.when(F.col("chunk_no") == 0, 0).otherwise(F.get("cuts", F.col("chunk_no") - 1))
    own = folded.select("id", "chunk_no", F.slice("c", begin + 1, F.col("to") - begin).alias("own"))
    words = F.slice(F.filter(F.split(F.array_join(F.transform("own", lambda x: x["t"]), " "), r"\s+"), lambda x: x != ""), 1, max_tokens)
    out = own.select("id", "chunk_no", F.element_at("own", 1)["start_sec"].alias("start_sec"), F.element_at("own", -1)["end_sec"].alias("end_sec"), words.alias("w"))
    return out.select("id", "chunk_no", "start_sec", "end_sec", F.array_join("w", " ").alias("text"), F.size("w").alias("token_count"))


def caption_quality(cues: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Words a minute and share of non-speech lines of each text, and whether it passes (60, 0.20).

    ``durations`` (id, sec) gives the length of the talks; without it a talk ends with its last cue.
    """
    lines = cues.select("id", "start_sec", "end_sec", F.explode("lines").alias("line"))
    marker = F.col("line").rlike(NO_SPEECH)
    said = lines.groupBy("id").agg(F.sum(F.regexp_count("line", F.lit(r"[\w']+"))).alias("words"), F.count("*").alias("n"), F.sum(F.when(marker, 1).otherwise(0)).alias("m"))
    span = cues.groupBy("id").agg(F.max("end_sec").alias("sec")) if durations is None else durations.select("id", F.col("sec").cast("double").alias("sec"))
    wpm = F.col("words") / F.greatest(F.col("sec") / 60, F.lit(1e-9))
    share = F.col("m") / F.greatest(F.col("n"), F.lit(1))
    out = span.join(said, "id")
    return out.select("id", F.round(wpm, 3).alias("words_per_minute"), F.round(share, 6).alias("non_speech"), ((wpm >= 60) & (share < 0.2)).alias("passes"))


#: Chunkers by name: cues of :func:`parse_captions` to chunks.
CHUNKERS = {"fixed_window": lambda cues: fixed_windows(settle_rollup(cues)), "transcript_segment": lambda cues: sentence_sessions(drop_rollup(cues))}


def chunker(name: str):
    """The chunker of a name; the error for an unknown one lists the names."""
    if name not in CHUNKERS:
        raise KeyError(f"unknown chunker {name!r}; known are {sorted(CHUNKERS)}")
    return CHUNKERS[name]


def caption_texts(cues: DataFrame) -> DataFrame:
    """Cues written as WebVTT texts: id, text."""
    one = F.concat(seconds_clock(F.col("start_sec")), F.lit(" --> "), seconds_clock(F.col("end_sec")), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n"))
    rows = cues.select("id", F.struct("cue_no", one.alias("t")).alias("c")).groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return rows.select("id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["t"]), "\n")).alias("text"))


def write_captions(cues: DataFrame, folder: str) -> None:
    """One folder a text, named by its id, with its WebVTT text."""
    caption_texts(cues).select("text", "id").write.mode("overwrite").partitionBy("id").text(folder)
