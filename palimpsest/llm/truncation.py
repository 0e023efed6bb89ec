"""Texts that were cut off before their end, and how often each source cuts.

Four kinds of evidence over all documents: (1) the text is a strict prefix of a longer text
elsewhere (sorted neighbours within equal fixed-length prefixes); (2) its last word is a strict
prefix of longer words elsewhere and nowhere a word of its own; (3) the text fills the field limit
of its source exactly, a limit being the longest length of a source at which lengths pile up; (4)
the text's own ending: its last word, sentence or opened structure is unfinished, judged before
whatever a sender added behind the break.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.functions.bloom import might_contain
from palimpsest.functions.json_index import parse
from palimpsest.session import materialize

#: Prefix whose equality brings texts together, rows per prefix from which it is refined, and the
#: most prefixes that are.
PREFIX_CHARS = 64
LONG_PREFIX_CHARS = 512
HOT_ROWS = 100_000
MAX_HOT_KEYS = 10_000

#: Letters of a fragment at least, and how often longer words with its beginning are to be seen.
FRAGMENT_CHARS = 2
FRAGMENT_SEEN = 3

#: A length is a field limit where this many texts of a source have it and none is longer,
#: if that is this many times what the lengths just below hold on average.
LIMIT_ROWS = 5
LIMIT_PEAK = 5.0
LIMIT_BELOW = 40

#: Field limits that are broadcast; more of them are joined by a shuffle.
MAX_LIMITS = 100_000

_FOOTERS = [
    re.compile(r"\n\s*\n\[[^\[\]\n]{1,80}\]\s*\Z"),  # a bracketed label in its own paragraph
    re.compile(r"\n-- ?\n[^\n]{1,80}(?:\n[^\n]{1,80}){0,3}\s*\Z"),  # a mail signature
    re.compile(r"\n-- [^\n]{1,80}\s*\Z"),  # a signature on one line
    re.compile(r"\n---+\n[^\n]{1,120}(?:\n[^\n]{1,120}){0,2}\s*\Z"),  # a rule and a notice
    re.compile(r"\n\[end of [^\[\]\n]{1,40}\]\s*\Z"),
]
_MARK = re.compile(r"(?:…|\.\.\.|�|\\u[0-9a-fA-F]{0,3}|\[(?:truncated|cut|snip|more)\]|(?<=[\w\s.,:/])-)\s*\Z", re.IGNORECASE)
_CLOSED = re.compile(r"[.!?。！？｡][\"'”’»«)\]}」』*_~`]*(?:\s+[^\w\s.,;:…\-]{1,6})*\s*\Z")
_AMOUNT = re.compile(r":\s*\d+[.,]\Z")
_ASIDE = re.compile(r"[.!?。！？][\"'”’»)\]]*\s+\([^()\n]*\)\s*\Z")
_QUOTED = re.compile(r"^(?:> ?)+", re.MULTILINE)
_LABEL = re.compile(r"(\$(?:/[^\s:]*)?|metadata/\S+?|[^\W\d_][\w -]{0,24}): *(\S.*)\Z")
_ENTRY = re.compile(r"(?:[-*•]|\d{1,3}[.)])\s+(.*)\Z", re.DOTALL)
_INNER_STOP = re.compile(r"[.!?。！？]\s")


def core(text: str) -> str:
    """The text without what a sender added behind it: labels, signatures and notices."""
    last = None
    while last != text:
        last = text
        for footer in _FOOTERS:
            text = footer.sub("", text)
    return text


_TAIL = re.compile(r"(?:\.\.\.|\\u[0-9a-f]{0,3}|\[(?:truncated|cut|snip|more)\])\Z", re.IGNORECASE)


def without_marks(text: str) -> str:
    """The text without the marks a cut leaves, which are not part of a longer copy."""
    last = None
    while last != text:
        last = text
        text = text.rstrip().rstrip("…\ufffd-")
        text = text[:-16] + _TAIL.sub("", text[-16:])
    return text


def _shape(entry: str) -> str:
    entry = re.sub(r"[^\W\d_]+", "w", entry)
    entry = re.sub(r"\d+", "9", entry)
    return re.sub(r"(?:w[ '’-]?)+", "w", entry)


def _after_record(text: str) -> str | None:
    """What follows a complete JSON value at the start of a text, or None without one."""
    try:
        _, at = json.JSONDecoder().raw_decode(text)
    except (ValueError, RecursionError):
        return None
    return text[at:].strip()


def _open_array(text: str) -> bool:
    """Whether a text that begins with ``[`` is a JSON array that the text's end interrupts, and not
    a bracketed label or prose."""
    try:
        json.JSONDecoder(strict=False).raw_decode(text)
    except json.JSONDecodeError as e:
        return e.msg.startswith("Unterminated string") or any(w.startswith(text[e.pos :]) for w in ("true", "false", "null", "-"))
    except ValueError:
        return False
    except RecursionError:
        return True
    return False


def ending(text: str, at_limit: bool = False) -> str:
    """How a text ends. Values that begin with ``cut`` mean that it was cut off."""
    text = core(text)
    bare = text.strip()
    letters = len(re.findall(r"\w", bare))
    if letters < 2 or (letters < 8 and len(bare.split()) < 2 and not _MARK.search(bare)):
        return "almost empty"
    if bare[0] in "{[" and parse(bare)[0]:
        return "complete record"
    if _MARK.search(bare):
        return "cut: mark"
    if bare[0] == "{":
        rest = _after_record(bare)
        if rest is None:
            return "cut: open record"
        return ending(rest, at_limit) if rest else "complete record"
    if bare[0] == "[" and _open_array(bare):
        return "cut: open record"
    lines = [x.strip() for x in _QUOTED.sub("", bare).split("\n") if x.strip()]
    if not lines:
        return "almost empty"
    line = lines[-1]
    if sum(x.startswith("```") for x in lines) % 2:
        return "cut: open block"
    if line.startswith("```"):
        return "closed block"
    if not re.search(r"\w", line):
        return "rule"
    if line[0] == "|":
        return "table row" if line[-1] == "|" and len(line) > 1 else "cut: table row"
    if line[0] == "[" and line[-1] == "]":
        return "label"
    if _AMOUNT.search(line):
        return "cut: number"
    entry = _ENTRY.match(line)
    if entry:
        peers = [m.group(1) for x in lines[:-1] if (m := _ENTRY.match(x))]
        shapes = {_shape(p) for p in peers}
        if peers and len(shapes) <= max(2, len(peers) // 3):
            if _shape(entry.group(1)) not in shapes:
                return "cut: list entry"
            digits = [len(m) for p in peers for m in re.findall(r"\d+\Z", p)]
            own = re.findall(r"\d+\Z", entry.group(1))
            if own and digits and len(own[0]) < min(3, min(digits)):
                return "cut: list entry"
            return "cut: list entry at limit" if at_limit else "list entry"
    if _CLOSED.search(line):
        return "sentence"
    if _ASIDE.search(line):
        return "aside"
    if entry and ":" in entry.group(1) and not entry.group(1).endswith(":") and not _INNER_STOP.search(entry.group(1)):
        return "cut: list entry at limit" if at_limit else "list entry"
    label = _LABEL.match(line)
    if label:
        value = label.group(2)
        path = label.group(1)[0] == "$" or label.group(1).startswith("metadata/")
        others = [bool(_LABEL.match(x)) for x in lines[:-1]]
        card = all(others) and (len(others) > 0 or len(line) < 60) and not any(_INNER_STOP.search(x) or _CLOSED.search(x) for x in lines)
        short = len(value.split()) <= (3 if path else 9)
        if not _INNER_STOP.search(value) and short and (path or card):
            return "cut: label at limit" if at_limit else "label"
    return "cut: sentence"


def last_label(text: str) -> str | None:
    """The label of a ``Label: value`` line at the end of a text."""
    lines = [x.strip() for x in _QUOTED.sub("", core(text).strip()).split("\n") if x.strip()]
    found = _LABEL.match(lines[-1]) if lines else None
    return found.group(1) if found else None


def prose_labels_of(cores: DataFrame) -> DataFrame:
    """(label) of the ``Label: value`` lines that mostly end like sentences, from the lines of all
    texts but each text's last: those whose share of such ends is half or more with 95 % confidence
    (the lower end of Wilson's interval), however many lines there are."""
    lines = cores.select(F.split("core", "\n").alias("l")).select(F.explode(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0)))).alias("line"))
    label = F.regexp_extract("line", r"^(\$(?:/[^\s:]*)?|\p{L}[\p{L}\w -]{0,24}): ", 1)
    closed = F.col("line").rlike(r"[.!?。！？][\"'”’»)\]]*\s*$")
    counted = lines.select(label.alias("label"), closed.cast("int").alias("closed")).filter(F.col("label") != "").groupBy("label").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("closed").alias("p")
    )
    z2 = 1.96**2
    n, p = F.col("n"), F.col("p")
    least = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    return counted.filter(least >= 0.5).select("label")


def field_limits(documents: DataFrame) -> DataFrame:
    """(source, unit, size) of the field limits: the longest length of a source, in characters or
    bytes, where lengths pile up. Lengths of all documents count, without what senders added."""
    sizes = documents.select(
        "source",
        F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("size")))),
    )
    # A cut at a byte limit may leave up to three bytes of a broken character behind.
    counted = sizes.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("source", "unit").orderBy("size")
    per = counted.withColumn("below", F.sum("n").over(by_size.rangeBetween(-LIMIT_BELOW, -4))).withColumn(
        "top", F.max("size").over(Window.partitionBy("source", "unit"))
    )
    # Limits are rarely passed: a source's stray longer texts are at most a twentieth of the pile.
    longer = F.sum("n").over(by_size.rangeBetween(1, Window.unboundedFollowing))
    return (
        per.withColumn("longer", F.coalesce(longer, F.lit(0)))
        .filter((F.col("n") >= LIMIT_ROWS) & (F.col("n") >= LIMIT_PEAK * F.coalesce("below", F.lit(0)) / (LIMIT_BELOW - 3)) & (F.col("longer") <= F.col("n") / 20))
        .groupBy("source", "unit")
        .agg(F.min("size").alias("size"))
    )


_CORES = "doc_id bigint, source string, core string, n_chars int, n_bytes int, bare_chars int"


def _cores(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text")).filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    target = T._parse_datatype_string(_CORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores = [core(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(cores, pa.string()), pa.array([len(t) for t in cores], pa.int32()),
                    pa.array([len(t.encode()) for t in cores], pa.int32()), pa.array([len(without_marks(t)) for t in cores], pa.int32()),
                ],
                names=target.names,
            )

    return docs.mapInArrow(run, target).dropDuplicates(["doc_id"])


def prefixes_of_longer(texts: DataFrame, prefix_chars: int = PREFIX_CHARS, hot_rows: int = HOT_ROWS, column: str = "core") -> DataFrame:
    """(bare) of the distinct values of ``column`` that are strict prefixes of another.

    In sorted order the first longer text that begins with a text follows it directly, and both
    share the fixed-length prefix that keys them to one sorted group. Texts shorter than that look
    themselves up among the beginnings of all others, where only a longer copy that goes on within
    the line counts. Groups of over ``hot_rows`` distinct texts are keyed by a longer prefix instead;
    their texts shorter than that look themselves up in the same way, however the copy goes on.
    """
    every = texts.select(F.col(column).alias("bare")).filter(F.length("bare") > 0).dropDuplicates(["bare"])
    distinct = every.filter(F.length("bare") >= prefix_chars)

    def following(df: DataFrame, keys: list[str]) -> DataFrame:
        ahead = F.lead("bare").over(Window.partitionBy(*keys).orderBy("bare"))
        return df.withColumn("ahead", ahead).filter(F.col("ahead").startswith(F.col("bare"))).select("bare")

    keyed = distinct.withColumn("key", F.xxhash64(F.substring("bare", 1, prefix_chars)))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).orderBy(F.desc("n"), "key").limit(MAX_HOT_KEYS).select("key")
    hot = materialize(hot, "hot")
    found = following(keyed.join(F.broadcast(hot), "key", "left_anti"), ["key"])

    few = every.filter(F.length("bare") < prefix_chars).withColumn("h", F.xxhash64("bare"))
    begins = every.filter(F.length("bare") > 1).select("bare", F.explode(F.sequence(F.lit(1), F.least(F.length("bare") - 1, F.lit(prefix_chars - 1)))).alias("size"))
    begins = begins.filter(F.expr("substring(bare, size + 1, 1)") != "\n").select(F.expr("left(bare, size)").alias("bare"))
    # Only beginnings that may be a short text travel.
    begins = begins.withColumn("h", F.xxhash64("bare")).filter(might_contain(few, "h", "h", 1_000_000)).select("bare")
    found = found.unionByName(few.select("bare").join(begins, "bare", "left_semi"))

    if not hot.isEmpty():
        warm = keyed.join(F.broadcast(hot), "key", "left_semi")
        long = warm.filter(F.length("bare") >= LONG_PREFIX_CHARS)
        long_found = following(long.withColumn("key2", F.xxhash64(F.substring("bare", 1, LONG_PREFIX_CHARS))), ["key", "key2"])
        short = warm.filter(F.length("bare") < LONG_PREFIX_CHARS)
        # At most LONG_PREFIX_CHARS lengths to look up per text, whatever the group's size.
        cut = warm.withColumn("size", F.explode(F.sequence(F.lit(prefix_chars), F.least(F.length("bare") - 1, F.lit(LONG_PREFIX_CHARS - 1))))).select(
            F.expr("left(bare, size)").alias("bare")
        )
        found = found.unionByName(long_found).unionByName(short.select("bare").join(cut, "bare", "left_semi"))
    return found.distinct()


def fragments(cores: DataFrame, last: DataFrame) -> DataFrame:
    """(last) of the words in ``last`` that no text has as a word before its end, while longer words
    begin with them: what a cut leaves of a word. Counted over the words of all texts."""
    inner = F.regexp_extract_all(F.rtrim("core"), F.lit(r"\p{L}++(?=\P{L})"), F.lit(0))
    seen = cores.select(F.explode(inner).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(seen, "words")
    asked = last.filter(F.length("last") >= FRAGMENT_CHARS).select("last").distinct()
    unseen = asked.join(seen.select(F.col("word").alias("last")), "last", "left_anti")
    begins = seen.filter(F.length("word") > FRAGMENT_CHARS).select("word", "n", F.explode(F.sequence(F.lit(FRAGMENT_CHARS), F.length("word") - 1)).alias("size"))
    longer = begins.select(F.expr("left(word, size)").alias("last"), "n").groupBy("last").agg(F.sum("n").alias("n"))
    return unseen.join(longer.filter(F.col("n") >= FRAGMENT_SEEN), "last", "left_semi")


_JUDGED = "doc_id bigint, source string, is_prefix boolean, at_limit boolean, ending string, last string, label string"
_LAST = re.compile(r"[^\W\d_]+\Z")


def judge(documents: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(doc_id, source, is_prefix, at_limit, ending, truncated), one row per doc_id with text.

    A text is truncated if its ending is cut, or if it is a strict prefix of a longer text, ends in a
    fragment of a word or fills its source's limit and does not end with a complete sentence or
    record. Null texts and ids give no rows; almost empty texts are whole; a null source has no limit
    of its own to fill but is reported. Other columns are not read.
    """
    cores = materialize(_cores(documents), "cores")
    limits = materialize(field_limits(cores.filter(F.col("source").isNotNull())), "limits")
    near = F.broadcast if limits.count() <= MAX_LIMITS else (lambda df: df)
    char = limits.filter("unit = 'chars'").select("source", F.col("size").alias("max_chars"))
    byte = limits.filter("unit = 'bytes'").select("source", F.col("size").alias("max_bytes"))
    bare = F.expr("left(core, bare_chars)")
    found = materialize(prefixes_of_longer(cores.select(bare.alias("core")), prefix_chars), "prefixes")
    # Prefixes are few beside the texts: the filter keeps all other texts where they are.
    maybe = F.coalesce(might_contain(found, "bare", "_bare", max(1, found.count())), F.lit(False))
    placed = cores.withColumn("_bare", bare).join(near(char), "source", "left").join(near(byte), "source", "left").withColumn("_maybe", maybe)
    with_copy = placed.filter("_maybe").join(found.select(F.col("bare").alias("_bare"), F.lit(True).alias("is_prefix")), "_bare", "left")
    without = placed.filter("NOT _maybe").withColumn("is_prefix", F.lit(False))
    marked = with_copy.unionByName(without).select(
        "doc_id", "source", "core", F.coalesce("is_prefix", F.lit(False)).alias("is_prefix"),
        F.coalesce((F.col("n_chars") == F.col("max_chars")) | F.col("n_bytes").between(F.col("max_bytes") - 3, F.col("max_bytes")), F.lit(False)).alias("at_limit"),
    )
    target = T._parse_datatype_string(_JUDGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, prefix, limit = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ends = [ending(t, p or x) for t, p, x in zip(texts, prefix, limit)]
            # The last word of a text that seems to end with an entry or a value.
            last = [m.group() if e in ("label", "list entry") and (m := _LAST.search(t.rstrip()[-200:])) else None for t, e in zip(texts, ends)]
            label = [last_label(t) if e in ("label", "cut: label at limit") else None for t, e in zip(texts, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), *[pa.array(c, pa.string()) for c in (ends, last, label)]], names=target.names
            )

    judged = materialize(marked.mapInArrow(run, target), "judged")
    sure, doubtful = judged.filter("last IS NULL AND label IS NULL"), judged.filter("last IS NOT NULL OR label IS NOT NULL")
    # A short value is no end where the label's values are sentences.
    prose = prose_labels_of(cores).withColumn("prose", F.lit(True))
    parted = fragments(cores, judged.filter("last IS NOT NULL")).withColumn("parted", F.lit(True))
    again = F.when(F.col("prose"), "cut: sentence").when(F.col("parted"), "cut: word").otherwise(F.col("ending"))
    doubtful = doubtful.join(prose, "label", "left").join(parted, "last", "left").withColumn("ending", again)
    columns = ["doc_id", "source", "is_prefix", "at_limit", "ending"]
    every = sure.select(*columns).unionByName(doubtful.select(*columns))
    return every.withColumn("truncated", F.col("ending").startswith("cut"))


def rates(judged: DataFrame) -> DataFrame:
    """(source, n_documents, n_truncated, rate) over all documents with text."""
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.col("truncated").cast("bigint")).alias("n_truncated"),
        F.avg(F.col("truncated").cast("double")).alias("rate"),
    )
