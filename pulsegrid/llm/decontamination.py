"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations.

An item's windows of consecutive words are sets that a document must contain whole. For
containment of all words the necessary prefix is one: the word of the window that is
rarest in the corpus. Only stretches of words that all belong to windows, and are long
enough for one (length bound), can hold any; such stretches and windows meet on the rarest
word only, the window must fit in at that place (positional bound), and its words are
compared.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.batches import documents, lower_ascii
from pulsegrid.session import written

#: Words of a window, and the share of hit words that makes a document contaminated: 1 / 20.
WINDOW, SHARE = 13, 20
#: Windows and bytes of windows in one block: a block is broadcast, further ones are further passes.
BLOCK_WINDOWS, BLOCK_BYTES = 20_000, 8 << 20

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z only): runs of letters, figures and all that is not ASCII."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS, -1), "")


def _one_of(words: list[str]) -> str:
    """Words hold neither quotes nor backslashes; Spark makes a hash set of the list."""
    return ", ".join(f"'{word}'" for word in words) or "NULL"


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words, n, items (ids as sorted strings)."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("all")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return (
        items.where(F.size("all") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("n", F.size("words"))
    )


def runs_of(docs: DataFrame, windows: DataFrame, markers: bool) -> DataFrame:
    """The stretches of documents that can hold a window: runs of words that all belong to
    some window, as long as the shortest window at least.

    Columns doc_id, text_key, n_words, from (place of the run's first word), run; with
    ``markers`` also one row per document without a run. The words live in a lambda
    variable, so a text is split once.
    """
    known = _one_of([row[0] for row in windows.select(F.explode("words")).distinct().collect()])
    least = windows.agg(F.coalesce(F.min("n"), F.lit(1))).first()[0]
    outside = f"filter(transform(ws, (w, i) -> if(w IN ({known}), NULL, i)), i -> i IS NOT NULL)"
    runs = f"""
      transform(array({outside}), out -> transform(
        filter(
          transform(concat(out, array(size(ws))), (o, k) -> named_struct('from', if(k = 0, 0, out[k - 1] + 1), 'to', o)),
          r -> r.to - r.from >= {least}),
        r -> named_struct('from', r.from, 'run', slice(ws, r.from + 1, r.to - r.from))))"""
    marker = "array(cast(NULL AS struct<from:int,run:array<string>>))" if markers else "array()"
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
        .select(
            "doc_id",
            "text_key",
            F.explode(
                F.expr(f"transform(array(words), ws -> named_struct('n', size(ws), 'runs', concat({marker}, flatten({runs}))))")
            ).alias("d"),
        )
        .select("doc_id", "text_key", F.col("d.n").alias("n_words"), F.explode("d.runs").alias("r"))
        .select("doc_id", "text_key", "n_words", "r.*")
    )


def rarest_words(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows that can occur, each with its rarest word (``anchor``) and that word's
    place in it (``offset``), by the count of words in ``runs``. A window with a word that
    no run has is left out."""
    counts = runs.select(F.explode("run").alias("word")).groupBy("word").count()
    places = windows.select("words", F.posexplode("words").alias("offset", "word"))
    rarest = (
        places.join(counts, "word", "left")
        .groupBy("words")
        .agg(
            F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "word")).alias("least")
        )
        .where("least.count > 0")
    )
    return windows.join(
        rarest.select("words", F.col("least.word").alias("anchor"), F.col("least.offset").alias("offset")), "words"
    )


def _blocks(df: DataFrame, weight: Column) -> list[DataFrame]:
    """``df`` cut by hash so that a part has about BLOCK_WINDOWS rows and BLOCK_BYTES at most."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    n = max(1, -(-rows // BLOCK_WINDOWS), -(-size // BLOCK_BYTES))
    if n == 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(n)) == i) for i in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of the text), n_words, n_hit, items
    (sorted ids as strings), contaminated.

    A word is hit when it lies in any occurrence of a window. An item of fewer words than
    ``window``, but not none, is one window. A null text, document or item, has no words;
    an item without id is left out; documents of equal id and text are computed once and
    returned as often as they come; other columns are not looked at. Only matched places
    and one row per document are shuffled; the benchmark is met block by block.
    """
    source = documents(docs, id_col, text_col)
    windows = written(windows_of(benchmark, item_id_col, item_text_col, window), "windows")
    found = None
    for i, block in enumerate(_blocks(windows, F.length(F.array_join("words", " ")))):
        runs = written(runs_of(source, block, markers=i == 0), "runs")
        part = _hits(runs, written(rarest_words(runs, block), "anchors"), window)
        found = part if found is None else found.unionByName(part)

    def cover(seen: Column, x: Column) -> Column:
        fresh = F.greatest(x["end"] - F.greatest(x["start"], seen["at"]), F.lit(0))
        return F.struct((seen["n"] + fresh).alias("n"), F.greatest(seen["at"], x["end"]).alias("at"))

    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
    per_document = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if("marker").alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("end").isNotNull(), F.struct("start", "end")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return (
        per_document.select(
            "doc_id",
            "text_key",
            F.col("n_words").cast("long").alias("n_words"),
            F.aggregate("hits", begin, cover, lambda seen: seen["n"]).cast("long").alias("n_hit"),
            "items",
            F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
        .drop("copy")
    )


def _hits(runs: DataFrame, anchored: DataFrame, window: int) -> DataFrame:
    """Occurrences of windows in runs, and the marker rows. Runs and windows meet on the
    windows' rarest words; the blocks bound what is broadcast. Each place of a run carries
    the words around it instead of the run."""
    reach = f"greatest(i - {window - 1}, 0)"
    places = F.expr(
        f"""if(run IS NULL, NULL, transform(array(run), ws -> transform(
              ws, (w, i) -> named_struct('anchor', w, 'place', i, 'base', {reach},
                                         'near', slice(ws, {reach} + 1, {2 * window - 1}))))[0])"""
    )
    placed = runs.select(
        "doc_id", "text_key", "n_words", "from", F.size("run").alias("long"), F.explode_outer(places).alias("at")
    ).select("doc_id", "text_key", "n_words", "from", "long", "at.*")
    start = F.col("place") - F.col("offset")
    fits = (
        (F.col("place") >= F.col("offset"))
        & (start + F.col("n") <= F.col("long"))
        & (F.slice("near", F.greatest(start - F.col("base"), F.lit(0)) + 1, F.col("n")) == F.col("words"))
    )
    matched = F.when(fits, F.col("from") + start)
    return (
        placed.join(F.broadcast(anchored), "anchor", "left")
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.col("place").isNull().alias("marker"),
            matched.alias("start"),
            (matched + F.col("n")).alias("end"),
            F.when(matched.isNotNull(), F.col("items")).alias("items"),
        )
        .where("marker OR end IS NOT NULL")
    )
