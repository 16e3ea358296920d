"""Removal of repeated runs of lines and of words, in native expressions only.

A text is cut into chunks of at least two lines at places that its content chooses: a
rolling hash over the hashes of ``ROLL`` lines ends a chunk where it is larger than at the
line before and not smaller than at the line behind. Lines put in or taken out move the
cuts next to them only, so the same passage gets the same chunks in every document. A
chunk that occurs more than once in the corpus stays where it occurs first, by
``doc_id`` and place, and is removed everywhere else once its bytes were compared.

Passages of words are found apart from lines, by winnowing: of every ``SPAN`` neighbouring windows of
``WINDOW`` words the one with the least hash is kept, so every passage of ``WINDOW + SPAN - 1`` (50) words
has a window that all its copies keep as well. Windows at the starts and ends of texts and lines are kept
too, so a passage of whole lines goes from end to end. Words in a window that stands earlier in the
corpus, or in the same text and not across itself, are removed; windows are compared by 64 and
256 bits of digests of their words. So a repeated passage of one long line goes as well as one
of many lines. What stays of it: the words before its first window and behind its last one (fewer than
``SPAN`` each), and passages without a whole window inside. ``op9_line_dedup``
leaves passages alone, because its SQL knows chunks only; the pipeline removes them.

Only hashes of chunks and windows are counted over the corpus, with partial sums before the shuffle, and
places are sent along once and kept of repeated hashes only;
texts travel by document, where passages are removed those only that a map of bits marks as holding
something repeated, and bytes of chunks only where their hash repeats.

A null text stays null, an empty one has one empty line and loses nothing. Chunks with
fewer than two lines that hold a word are never removed as chunks, so short single lines and blank runs stay.
Of rows with equal ``doc_id`` and text all lose the same chunks. Chunks whose hash also
stands for other bytes are left alone. All other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import let
from gradeloom.llm.registry import query, table, written

ROLL = 2
STEP, MODULUS = 1_000_003, 4_294_967_291
LEAST_LINES = 2
#: Words of a window.
WINDOW = 25
#: Neighbouring windows of which one is kept at least, and the words that a window is chosen by.
SPAN, GRAM = 26, 3
#: Bits of a word's place in a text.
PLACE_BITS = 30
#: Bits of the map of texts that hold something repeated, 16 MB, and of one of its rows.
FLAGS, FLAGS_ROW = 1 << 27, 1 << 15
#: Windows are numbered by their first word from here on, chunks from 0.
WINDOWS = 1 << 30
SPACES = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5 digest."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(lines: Column) -> Column:
    """The chunks of a text's lines: an array of (first line, number of lines), in order.

    Arrays that the steps look into are bound by ``let``, so they are made once for a text
    and not once for every line, however Spark merges the projections.
    """

    def rolled(hashes: Column) -> Column:
        return F.transform(
            hashes, lambda h, i: (F.coalesce(F.get(hashes, i - 1), F.lit(0)) * STEP + h) % MODULUS
        )

    def ends(values: Column) -> Column:
        def cut(value: Column, i: Column) -> Column:
            inside = (i >= LEAST_LINES - 1) & (i < F.size(values) - LEAST_LINES)
            return F.when(inside & (value > F.get(values, i - 1)) & (value >= F.get(values, i + 1)), i)

        last = F.array(F.size(values) - 1)
        return F.concat(F.array_compact(F.transform(values, cut)), last)

    def between(stops: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            before = F.coalesce(F.get(stops, k - 1), F.lit(-1))
            return F.struct((before + 1).alias("first"), (end - before).alias("n"))

        return F.transform(stops, chunk)

    return let(between, let(ends, let(rolled, F.transform(lines, line_hash))))


def with_chunks(df: DataFrame, text: str) -> DataFrame:
    """Add the text's ``_lines`` and ``_chunks``."""
    return df.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).withColumn(
        "_chunks", chunks_of(F.col("_lines"))
    )


def lines_of(lines: Column, chunk: Column) -> Column:
    return F.slice(lines, chunk["first"] + 1, chunk["n"])


def bytes_of(lines: Column, chunk: Column) -> Column:
    return F.array_join(lines_of(lines, chunk), "\n")


def tokens_of(text: Column) -> Column:
    """The words of a text, each with the white space behind it; leading white space is one more."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=\s)(?=\S)", -1)


def window_at(words: Column, start: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, WINDOW), " ")


def winnowed(hashes: Column) -> Column:
    """Starts of the windows that are least among ``SPAN`` neighbours, by the hash of their first words.

    Hash and place share one number, so the least one names its place, the first one of equal hashes.
    """

    def least(grams: Column) -> Column:
        groups = F.sequence(F.lit(0), F.greatest(F.size(grams) - SPAN, F.lit(0)))
        places = (1 << PLACE_BITS) - 1
        return F.array_distinct(
            F.transform(groups, lambda j: F.array_min(F.slice(grams, j + 1, SPAN)).bitwiseAND(F.lit(places)).cast("int"))
        )

    def gram(i: Column) -> Column:
        mixed = F.xxhash64(*[F.get(hashes, i + k) for k in range(GRAM)])
        return F.shiftleft(F.shiftright(mixed, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    return let(least, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), gram))


def windows_of(tokens: Column) -> Column:
    """The windows of a text: an array of (_i, _h)."""

    def ends(tokens: Column) -> Column:
        """Starts of windows that begin or end with a text or line."""
        last = F.size(tokens) - WINDOW

        def broken(token: Column) -> Column:
            return F.contains(token, F.lit("\n"))

        def chosen(i: Column) -> Column:
            at_end = broken(F.get(tokens, i - 1)) | broken(F.get(tokens, i + WINDOW - 1))
            return (i == 0) | (i == last) | at_end

        return F.filter(F.sequence(F.lit(0), last), chosen)

    def hashed(tokens: Column, words: Column) -> Column:
        starts = F.array_union(let(winnowed, F.transform(words, lambda w: F.xxhash64(w))), ends(tokens))
        found = F.transform(
            starts, lambda i: F.struct((i + WINDOWS).alias("_i"), F.xxhash64(window_at(words, i)).alias("_h"))
        )
        none = F.array().cast("array<struct<_i:int,_h:bigint>>")
        return F.when(F.size(tokens) >= WINDOW, found).otherwise(none)

    return let(hashed, tokens, words_of(tokens))


def words_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.rtrim(t, F.lit(SPACES)))


def flag_place() -> Column:
    return F.pmod(F.xxhash64("_id", "_key"), F.lit(FLAGS))


def flags_of(texts: DataFrame) -> DataFrame:
    """A map of bits of fixed size in which the texts (_id, _key) are marked: (_part, _bits)."""
    return texts.select(
        F.call_function("div", flag_place(), F.lit(FLAGS_ROW)).alias("_part"), (flag_place() % FLAGS_ROW).alias("bit")
    ).groupBy("_part").agg(F.bitmap_construct_agg("bit").alias("_bits"))


def with_flag(keyed: DataFrame, flags: DataFrame) -> DataFrame:
    """Add ``_flag``: whether a text is marked, or shares its bit with one that is.

    Only marked texts have to travel; what the map says of the others is certain, and its
    size is fixed, so it is broadcast.
    """
    bit = flag_place() % FLAGS_ROW
    byte = F.substring(F.col("_bits"), F.call_function("div", bit, F.lit(8)).cast("int") + 1, F.lit(1))
    marked = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) % 2 == 1
    placed = keyed.withColumn("_part", F.call_function("div", flag_place(), F.lit(FLAGS_ROW)))
    return placed.join(F.broadcast(flags), "_part", "left").select(
        *keyed.columns, F.coalesce(marked, F.lit(False)).alias("_flag")
    )


def repeated_chunks(keyed: DataFrame, passages: bool) -> tuple[DataFrame, DataFrame]:
    """(_id, _key, _removed): the numbers of the chunks and windows that each text loses.

    Also ``keyed`` with ``_flag``, false for texts that lose nothing for certain.
    """

    def hashes(lines: Column, chunks: Column) -> Column:
        """(_i, _h) for each chunk; the hash is null where too few lines hold a word."""

        def of_chunk(chunk: Column, i: Column) -> Column:
            filled = F.filter(lines_of(lines, chunk), lambda line: F.rlike(line, F.lit(WORD)))
            hashed = F.when(F.size(filled) >= LEAST_LINES, F.xxhash64(bytes_of(lines, chunk)))
            return F.struct(i.alias("_i"), hashed.alias("_h"))

        return F.transform(chunks, of_chunk)

    def shown_bytes(found: Column, lines: Column, chunks: Column, words: Column) -> Column:
        def shown(f: Column) -> Column:
            window = F.unhex(F.sha2(window_at(words, f["_i"] - WINDOWS), 256))
            own = F.when(f["_i"] < WINDOWS, bytes_of(lines, F.get(chunks, f["_i"])).cast("binary")).otherwise(window)
            return F.struct(f["_h"].alias("h"), own.alias("bytes"))

        return F.transform(found, shown)

    numbered = let(hashes, F.col("_lines"), F.col("_chunks"))
    if passages:
        numbered = F.concat(numbered, let(windows_of, tokens_of(F.col("_text"))))
    hashed = with_chunks(keyed.select("_id", "_key", "_text"), "_text").select("_id", "_key", F.inline(numbered))
    # Small rows, read twice: the texts are cut and hashed once.
    hashed = written(hashed.where(F.col("_h").isNotNull()), "chunks")
    often = written(hashed.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    # Three plans use these rows, each with other columns, so none would share the shuffle of all hashes with another.
    found = written(hashed.join(often, "_h"), "found")
    # The bytes behind the repeated hashes, each text's once.
    listed = found.groupBy("_id", "_key").agg(F.collect_list(F.struct("_i", "_h")).alias("_found"))
    keyed = with_flag(keyed, flags_of(listed.select("_id", "_key"))) if passages else keyed.withColumn("_flag", F.lit(True))
    words = words_of(tokens_of(F.col("_text"))) if passages else F.array().cast("array<string>")
    shown = (
        with_chunks(joined(keyed.where("_flag").select("_id", "_key", "_text"), listed, "inner"), "_text")
        .select(F.explode(let(shown_bytes, F.col("_found"), F.col("_lines"), F.col("_chunks"), words)).alias("c"))
        .groupBy("c.h", "c.bytes")
        .agg(F.lit(1).alias("one"))
    )
    same = shown.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    place = F.struct("_id", "_key", "_i")
    firsts = found.groupBy("_h").agg(F.min(place).alias("_first"))
    # Stored, so that the one join left may split a frequent hash over tasks.
    known = written(firsts.join(same, "_h"), "firsts")
    first = F.col("_first")
    across = first["_id"].eqNullSafe(F.col("_id")) & (first["_key"] == F.col("_key")) & (
        F.col("_i") - first["_i"] < WINDOW
    )
    stays = F.when(F.col("_i") < WINDOWS, first.eqNullSafe(place)).otherwise(across)
    lost = found.join(known, "_h").where(~stays).groupBy("_id", "_key").agg(F.collect_list("_i").alias("_removed"))
    return lost, keyed


def without_windows(starts: Column, chunks_gone: Column, tokens: Column) -> Column:
    """The text without the windows at ``starts`` (in order) and the tokens marked in ``chunks_gone``."""

    def marked(starts: Column) -> Column:
        def part(start: Column, k: Column) -> Column:
            room = F.coalesce(F.get(starts, k + 1), F.size(tokens)) - start
            inside = F.array_repeat(F.lit(True), F.least(room, F.lit(WINDOW)))
            return F.concat(inside, F.array_repeat(F.lit(False), F.greatest(room - WINDOW, F.lit(0))))

        before = F.array(F.array_repeat(F.lit(False), F.get(starts, F.lit(0))))
        return F.flatten(F.concat(before, F.transform(starts, part)))

    def text(gone: Column, chunks_gone: Column) -> Column:
        stay = F.filter(tokens, lambda t, j: ~(F.get(gone, j) | F.get(chunks_gone, j)))
        end = F.size(tokens) - 1
        kept = F.array_join(stay, "")
        return F.when(F.get(gone, end) | F.get(chunks_gone, end), F.rtrim(kept, F.lit(SPACES))).otherwise(kept)

    return let(text, let(marked, starts), chunks_gone)


def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the two key columns, nulls equal."""
    other = right.withColumnsRenamed({"_id": "_id2", "_key": "_key2"})
    return left.join(other, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), how).drop(
        "_id2", "_key2"
    )


def dedup_lines(docs: DataFrame, text: str = "text", order: str = "doc_id", passages: bool = True) -> DataFrame:
    """For each row of ``docs``: the row as a struct ``_row``, ``_kept`` (its text without repeated
    chunks and, with ``passages``, repeated windows of words), ``_n_lines``, ``_n_removed`` (lines of the
    chunks; all lines if no word stays) and ``_n_chunks_removed`` (chunks and windows)."""
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs[order].alias("_id"),
        docs[text].alias("_text"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("_key"),
    )
    lost, keyed = repeated_chunks(keyed, passages)

    def rest(removed: Column, lines: Column, chunks: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), removed)
        gone = F.transform(removed, lambda i: F.get(chunks, i)["n"].cast("long"))
        return F.struct(
            F.array_join(F.transform(stay, lambda i: bytes_of(lines, F.get(chunks, i))), "\n").alias("kept"),
            F.size(lines).cast("long").alias("n_lines"),
            F.aggregate(gone, F.lit(0).cast("long"), lambda total, n: total + n).alias("n_removed"),
            F.size(removed).cast("long").alias("n_chunks_removed"),
        )

    def rest_of_words(removed: Column, lines: Column, chunks: Column, text: Column) -> Column:
        """As ``rest``, for texts that lose windows."""
        starts = F.array_sort(F.transform(F.filter(removed, lambda i: i >= WINDOWS), lambda i: i - WINDOWS))
        cut = F.filter(removed, lambda i: i < WINDOWS)

        def marks(chunk: Column, k: Column) -> Column:
            words = F.regexp_count(bytes_of(lines, chunk), F.lit(r"\S+"))
            return F.array_repeat(F.array_contains(cut, k), words)

        lead = F.array(F.array_repeat(F.lit(False), F.when(F.rlike(text, F.lit(r"^\s")), 1).otherwise(0)))
        chunks_gone = F.flatten(F.concat(lead, F.transform(chunks, marks)))

        def result(kept: Column, plain: Column) -> Column:
            lost = ~F.rlike(kept, F.lit(WORD))
            return F.struct(
                F.when(lost, "").otherwise(kept).alias("kept"),
                plain["n_lines"].alias("n_lines"),
                F.when(lost, plain["n_lines"]).otherwise(plain["n_removed"]).alias("n_removed"),
                F.size(removed).cast("long").alias("n_chunks_removed"),
            )

        return let(result, let(without_windows, starts, chunks_gone, tokens_of(text)), let(rest, cut, lines, chunks))

    def all_rest(removed: Column, lines: Column, chunks: Column, text: Column) -> Column:
        plain = let(rest, removed, lines, chunks)
        words = let(rest_of_words, removed, lines, chunks, text)
        return F.when(F.exists(removed, lambda i: i >= WINDOWS), words).otherwise(plain)

    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    met = joined(keyed.where("_flag").drop("_flag"), lost, "left")
    if passages:
        # The others stay where they are.
        others = keyed.where("not _flag").drop("_flag")
        met = met.unionByName(others.withColumn("_removed", F.lit(None).cast("array<int>")))
    return (
        with_chunks(met, "_text")
        .select(
            "_row",
            "_text",
            (
                let(all_rest, removed, F.col("_lines"), F.col("_chunks"), F.col("_text"))
                if passages
                else let(rest, removed, F.col("_lines"), F.col("_chunks"))
            ).alias("_new"),
        )
        .select(
            "_row",
            F.when(F.col("_new.n_chunks_removed") == 0, F.col("_text")).otherwise(F.col("_new.kept")).alias("_kept"),
            F.col("_new.n_lines").alias("_n_lines"),
            F.col("_new.n_removed").alias("_n_removed"),
            F.col("_new.n_chunks_removed").alias("_n_chunks_removed"),
        )
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks and passages cut out of ``text`` (and ``n_chars``, where there is one, set anew).

    A document that had a text and lost all of it goes.
    """
    kept = dedup_lines(docs)
    changed = F.col("_n_chunks_removed") > 0
    new = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        length = F.length("_kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, length).otherwise(new["n_chars"])
    rest = kept.where(~changed | (F.col("_n_removed") < F.col("_n_lines")))
    return rest.select(*[value.alias(c) for c, value in new.items()])


_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (
    SELECT doc_id, lines, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM d
),
r AS (
    SELECT doc_id, lines, list_transform(range(1, len(hs) + 1), lambda i:
        (coalesce(hs[CASE WHEN i > 1 THEN i - 1 END], 0) * {STEP} + hs[i]) % {MODULUS}) AS rs
    FROM h
),
e AS (
    SELECT doc_id, lines, list_concat(list_filter(range({LEAST_LINES}, len(rs) - {LEAST_LINES} + 1),
        lambda i: rs[i] > rs[i - 1] AND rs[i] >= rs[i + 1]), [len(rs)]) AS ends
    FROM r
),
c AS (
    SELECT doc_id, k, lines[(CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END) + 1 : ends[k]] AS part
    FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS k FROM e)
),
g AS (
    SELECT doc_id, k, part, array_to_string(part, chr(10)) AS bytes,
           len(list_filter(part, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) >= {LEAST_LINES} AS counts
    FROM c
),
m AS (
    SELECT *, counts AND row_number() OVER (PARTITION BY bytes, counts ORDER BY doc_id, k) > 1 AS gone FROM g
)
SELECT doc_id, sum(len(part))::BIGINT AS n_lines,
       coalesce(sum(len(part)) FILTER (gone), 0)::BIGINT AS n_removed,
       count(*) FILTER (gone) AS n_chunks_removed,
       sha256(coalesce(string_agg(bytes, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op9_line_dedup", _SQL)
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_lines(docs, passages=False).select(
        "_row.doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_chunks_removed").alias("n_chunks_removed"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"),
    )
