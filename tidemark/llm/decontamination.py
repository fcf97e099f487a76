"""Benchmark decontamination with a distributed positional inverted index.

The index has a posting (term, text, position) for every word of the corpus that
occurs in a benchmark item, and is stored once. A window of an item (`window`
consecutive words, or all of a shorter item) is looked up from its rarest words
on: the list of the rarest one, moved back by its offset, gives candidate places;
they are intersected with the moved lists of the next ones. Frequencies come from
the index. Two lists leave few places, and further ones belong to ever more
frequent words; so what is left is compared with the words of the document itself,
and the result holds whole windows only. With `slop` the lists may disagree by
that many words; then every word of the window is looked for in the document
within `slop` of its expected place, which gives proximity matches.

Texts are known by a 64-bit key, so copies share their candidates; a clash of keys
can only add candidates, which the comparison rejects. Everything is DataFrame
code. The words of the benchmark are broadcast if they take `BROADCAST_BYTES` at
most, and joined by a shuffle if not. The other joins are left to Spark.

Defined cases: null has no words; an item without words matches nothing; equal
items are found together; items are told apart by id; null ids are ignored, or
with `unnamed` hit without being named; repeated documents get equal answers; an
empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, packed, stored, text_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. The fast function is right where all characters are single bytes."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words with an empty one at either end where the text begins or ends with a separator."""
    return F.split(lower_ascii(text), SEPARATORS)


def sized_broadcast(frame: DataFrame, column: str | None = None) -> DataFrame:
    """A frame of numbers and one text column at most, broadcast if its rows are known to be small enough."""
    wide = F.octet_length(column).cast("long") if column else F.lit(0)
    size = frame.agg(F.sum(wide + 64)).first()[0] or 0
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str, unnamed: bool = False) -> DataFrame:
    """(window_id, words, items): the distinct windows and the sorted ids that hold them, as strings.

    Items with null ids are left out, or with `unnamed` have windows but no id.
    """
    chosen = items if unnamed else items.where(F.col(id_col).isNotNull())
    cleaned = chosen.select(
        F.col(id_col).cast("string").alias("item"), F.filter(words_of(F.col(text_col)), lambda w: w != "").alias("words")
    )
    cut = cleaned.where(F.size("words") > 0).select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))),
                lambda i: F.slice("words", i, window),
            )
        ).alias("words"),
    )
    grouped = cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stored(grouped.withColumn("window_id", F.monotonically_increasing_id()), "windows")


def build_index(documents: DataFrame, windows: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(terms, postings): (term, word), and (term, text, position) of every occurrence in the documents."""
    words = windows.select(F.explode("words").alias("word")).distinct()
    terms = stored(words.withColumn("term", F.monotonically_increasing_id()), "terms")
    tokens = documents.select(
        text_key(text_col).alias("text"), F.posexplode(words_of(F.col(text_col))).alias("position", "word")
    )
    postings = stored(
        tokens.join(sized_broadcast(terms, "word"), "word").select("term", "text", "position"), "postings"
    )
    return terms, postings


def lookups(windows: DataFrame, terms: DataFrame, postings: DataFrame, lists: int) -> DataFrame:
    """(window_id, place, offset, term): the words of every window from the rarest on, `lists` at most.

    Windows with a word that the corpus lacks are left out.
    """
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    known = stored(terms.join(frequency, "term"), "term-frequencies")
    rows = windows.select("window_id", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word")).join(
        known, "word"
    )
    by = Window.partitionBy("window_id")
    order = by.orderBy("n", "offset")
    return stored(
        rows.withColumn("place", F.row_number().over(order))
        .withColumn("found", F.count("*").over(by))
        .where(f"found = length and place <= {lists}")
        .select("window_id", "place", "offset", "term", F.least("length", F.lit(lists)).alias("lists")),
        "lookups",
    )


def candidates(postings: DataFrame, looked: DataFrame, lists: int, slop: int = 0) -> DataFrame:
    """(text, start, window_id): where the moved lists of a window's rarest words meet, within `slop` words."""
    first = sized_broadcast(looked.where("place = 1"))
    found = stored(
        postings.join(first, "term")
        .select("text", (F.col("position") - F.col("offset")).alias("start"), "window_id", "lists")
        .where(f"start >= -{slop}").distinct(),
        "candidates",
    )
    for place in range(2, lists + 1):
        these = looked.where(F.col("place") == place)
        # Of the index only the lists that this step reads; copies of a text have one entry.
        read = postings.join(sized_broadcast(these.select("term").distinct()), "term", "left_semi").distinct()
        wanted = found.join(these.select("window_id", "term", "offset"), "window_id").withColumn(
            "there", F.col("start") + F.col("offset")
        )
        if slop:
            width = slop + 1
            near = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("there") / width) + d)
            met = wanted.withColumn("cell", F.explode(near)).join(
                read.withColumn("cell", F.floor(F.col("position") / width)), ["text", "term", "cell"]
            ).where(F.abs(F.col("there") - F.col("position")) <= slop)
        else:
            met = wanted.join(read.withColumnRenamed("position", "there"), ["text", "term", "there"])
        met = met.select(*found.columns)
        found = stored((met.distinct() if slop else met).unionByName(found.where(F.col("lists") < place)), "candidates")
    return found.drop("lists")


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    lists: int = 2,
    unnamed: bool = False,
) -> DataFrame:
    """The documents' columns, n_words, n_hit, items, spans and contaminated.

    A word is hit if it lies in an occurrence of a window; `items` are the ids, as
    sorted strings, of the items with an occurring window; `spans` the occurrences
    (start, words) in words. With `unnamed` benchmark rows without an id hit words
    too, and are in no `items`.
    """
    made = ["n_words", "n_hit", "items", "spans", "contaminated"]
    windows = windows_of(benchmark, window, item_id_col, item_text_col, unnamed)
    terms, postings = build_index(documents, windows, text_col)
    places = candidates(postings, lookups(windows, terms, postings, lists), lists)
    # Stored, so that the join below is a join of two plain inputs and a hot text can be split.
    per_text = stored(
        places.join(windows, "window_id").groupBy(F.col("text").alias("of"))
        .agg(F.collect_list(F.struct("start", "words", "items")).alias("places")),
        "places",
    )
    rows = packed(documents, made, key=text_key(text_col))
    joined = rows.join(per_text, rows["key"] == per_text["of"], "left")
    return (
        joined.withColumn("w", words_of(F.coalesce(F.col("row")[text_col], F.lit(""))))
        .withColumn(
            "hits",
            F.filter(
                F.coalesce("places", F.array().cast(joined.schema["places"].dataType)),
                lambda p: F.slice("w", p["start"] + 1, F.size(p["words"])) == p["words"],
            ),
        )
        # The first of the words may be the empty one before a separator.
        .withColumn("skip", F.when(F.col("w")[0] == "", 1).otherwise(0))
        .select(
            "row.*",
            F.size(F.filter("w", lambda x: x != "")).cast("long").alias("n_words"),
            F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform("hits", lambda p: F.sequence(p["start"], p["start"] + F.size(p["words"]) - 1))
                    )
                )
            ).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda p: p["items"])))).alias("items"),
            F.array_sort(
                F.transform(
                    "hits", lambda p: F.struct((p["start"] - F.col("skip")).alias("start"), F.size(p["words"]).alias("words"))
                )
            ).alias("spans"),
            (F.size("hits") > 0).alias("contaminated"),
        )
    )


def proximity_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    slop: int,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    lists: int = 3,
) -> DataFrame:
    """(id, item): documents in which all words of one of the item's windows lie as in the phrase, each at most
    `slop` words away from where the rarest one puts it. The `lists` rarest words find the places to look at."""
    windows = windows_of(benchmark, window, item_id_col, item_text_col)
    terms, postings = build_index(documents, windows, text_col)
    places = candidates(postings, lookups(windows, terms, postings, lists), lists, slop)
    # As in `decontaminate`, a join of two plain inputs: copies of a text are compared each with its own words.
    per_text = stored(
        places.join(windows, "window_id").groupBy(F.col("text").alias("of"))
        .agg(F.collect_list(F.struct("start", "words", "items")).alias("places")),
        "places",
    )
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("key"))
    joined = rows.join(per_text, F.col("key") == F.col("of")).withColumn("w", words_of(F.col("text")))

    def near(p: Column) -> Column:
        # Places before the first word are negative; slice() takes none, so the part begins at 0 at least.
        def there(word: Column, i: Column) -> Column:
            first = F.greatest(p["start"] + i - slop, F.lit(0))
            last = p["start"] + i + slop
            return F.array_contains(F.slice("w", first + 1, F.greatest(last - first + 1, F.lit(0))), word)

        return F.forall(F.transform(p["words"], there), lambda x: x)

    items = F.array_distinct(F.flatten(F.transform(F.filter("places", near), lambda p: p["items"])))
    return joined.select("id", F.explode(items).alias("item"))
