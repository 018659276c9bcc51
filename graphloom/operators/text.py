"""Ranked retrieval: tokens, uni- and bigram TF-IDF, cosine, top k.

An index is three tables: weights (doc, term, w), norms (doc, norm) and idf (term, idf). Weights: tf = 1 + ln(count), idf = ln((1 + N) / (1 + df)) + 1,
vectors scaled to length 1; the vocabulary keeps the most frequent terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.naming import expand_camel
from .graph import keep

#: Fixed value: a CJK or kana character, or a word of two or more.
TOKEN = "(?U)[一-鿿぀-ヿ]|\\b\\w\\w+\\b"
MAX_QUERY, MAX_TOP_K = 1000, 50
#: What else a class is searched by, for its whole name or else the first that it ends in.
ALIASES = {
    "DiskManager": "磁碟 讀寫 I/O 讀取 寫入 磁碟管理 disk read write block lba storage io",
    "NVMeController": "NVMe 提交 佇列 完成 控制 控制器 submit queue completion poll drive",
    "BufferPool": "記憶體 緩衝區 分配 釋放 緩衝池 memory buffer allocate release dma pool",
    "CacheManager": "快取 緩存 key value 存取 查詢 cache lookup store evict lru",
    "NVMeDriver": "硬體 驅動程式 初始化 驅動 NVMe硬體 hardware driver init dma nvme device",
    "EventHandler": "事件 通知 訂閱 處理 事件處理 event listener subscribe callback dispatch handler",
    "RequestFactory": "工廠 物件 實例 產生 建立 請求 factory create instance new make request object",
    "TaskScheduler": "任務 排程 優先 佇列 優先佇列 task schedule background priority queue scheduling",
    "DataSerializer": "序列化 反序列化 資料結構 轉換 二進位 serialize deserialize binary format convert",
    "ResourceManager": "元件 生命週期 資源 釋放 資源管理 lifecycle resource release manage component",
    "Manager": "管理 管理器 管理類 manage lifecycle",
    "Handler": "處理 處理器 handle event listener callback",
    "Factory": "工廠 產生 實例 建立 create new instance make",
    "Scheduler": "排程 排程器 schedule task background priority",
    "Driver": "驅動 驅動程式 驅動器 hardware init driver device",
    "Serializer": "序列化 反序列化 serialize deserialize binary format",
    "Pool": "緩衝池 儲存池 分配 allocate release buffer pool",
    "Controller": "控制 控制器 submit queue control",
    "Cache": "快取 緩存 cache lookup key value",
}


def tokenized(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spaced_cjk(text: Column) -> Column:
    """CJK characters set apart, so that words beside them keep their letters."""
    return F.regexp_replace(text, "([一-鿿぀-ヿ])", " $1 ")


def aliases(name: Column, table: dict[str, str] = ALIASES) -> Column:
    """The aliases of a class name: those of the whole name, else of the first key that it ends in, else null."""
    found = [F.when(name == key, F.lit(said)) for key, said in table.items()] + [F.when(name.endswith(key), F.lit(said)) for key, said in table.items()]
    return F.coalesce(*found)


#: The columns that make the text of an entry, in order, each optional but the name, and the signs that part their words.
ENTRY = {
    "namespace": "string", "responsibility": "string", "attributes": "array<string>", "interfaces": "array<string>", "methods": "array<struct<signature:string,used_types:array<string>>>",
    "bases": "array<string>", "deps": "array<struct<target:string,type:string>>", "template_params": "array<string>",
}
SIGNS, FIELD_SIGNS = r"[()<>,*&]", r"[()<>,*&+\-#]"


def entry_text(entries: DataFrame, name: str = "name") -> Column:
    """The searchable text of an entry, its name five times; missing columns and nulls add nothing."""
    col = {c: (F.col(c) if c in entries.columns else F.lit(None)).cast(t) for c, t in ENTRY.items()}
    own = F.coalesce(F.col(name), F.lit(""))
    spaced = lambda c: F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    plain = lambda c: F.regexp_replace(c, SIGNS, " ")
    one = lambda c: F.array(F.nullif(c, F.lit("")))
    each = lambda c, f: F.flatten(F.transform(col[c], f))
    other = aliases(own)
    parts = (
        F.array_repeat(F.nullif(own, F.lit("")), 5),
        F.array(F.when(spaced(own) != own, spaced(own)), other, F.regexp_replace(other, "([一-鿿぀-ヿ])", " $1 ")),
        one(F.replace(col["namespace"], F.lit("::"), F.lit(" "))),
        one(col["responsibility"]),
        F.transform(col["attributes"], lambda a: F.regexp_replace(a, FIELD_SIGNS, " ")),
        each("interfaces", lambda i: F.array(plain(i), F.nullif(expand_camel(F.regexp_extract(i, r"(\w+)\s*\(", 1)), F.lit("")))),
        each("methods", lambda m: F.concat(one(plain(m["signature"])), F.flatten(F.transform(F.coalesce(m["used_types"], F.array().cast("array<string>")), lambda t: F.array(F.substring_index(t, "::", -1), expand_camel(F.substring_index(t, "::", -1))))))),
        each("bases", lambda b: F.array(b, spaced(b))),
        each("deps", lambda d: F.when(d["target"] != "", F.array(d["target"], spaced(d["target"]), d["type"])).otherwise(F.array().cast("array<string>"))),
        col["template_params"],
    )
    none = F.array().cast("array<string>")
    return F.array_join(F.flatten(F.array(*[F.coalesce(p, none) for p in parts])), " ")


def matched_methods(methods: Column, words: Column) -> Column:
    """Signatures of the methods (signature, used_types) that share a word with a query's ``words``, why an entry was found."""
    short = lambda t: F.substring_index(t, "::", -1)

    def words_of(m: Column) -> Column:
        used = F.coalesce(m["used_types"], F.array().cast("array<string>"))
        types = F.flatten(F.transform(used, lambda t: F.concat(F.array(F.lower(short(t))), F.regexp_extract_all(expand_camel(short(t)), F.lit("[a-z]+"), F.lit(0)))))
        return F.concat(tokenized(F.coalesce(m["signature"], F.lit(""))), types)

    return F.transform(F.filter(methods, lambda m: F.arrays_overlap(words_of(m), words)), lambda m: m["signature"])


def term_counts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, term, n: words and pairs of neighbouring words."""
    rows = docs.select(F.col(doc).alias("doc"), tokenized(F.col(text)).alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    terms = rows.select("doc", F.explode(F.concat("t", pairs)).alias("term"))
    return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Index:
    """weights (doc, term, w) of known terms, the length (norm) of each document's vector, and idf.

    An index that was just built also has ``counts`` (doc, ids, n; a row for each document) and ``places`` (id, term, idf).
    """

    weights: DataFrame
    norms: DataFrame
    idf: DataFrame
    counts: DataFrame | None = None
    places: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """doc, term, w: weights of vectors scaled to length 1, document by document."""
        return self.weights.select("doc", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))).alias("w"))

    def save(self, path: str) -> None:
        for name in ("weights", "norms", "idf"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("weights", "norms", "idf")))


#: Rows of idf or of queries' terms that are broadcast at most; more are joined by a shuffle.
TERMS = 200_000


#: Characters of text that one task of an index takes, about: its counts stay in memory.
CHARS = 8_000_000
#: From so many tasks on, terms that a piece of the texts has once are left out of the first count.
PIECES = 8


def _pieces(docs: DataFrame, text: str = "text") -> int:
    return 1 + (docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0) // CHARS


def _occurrences(words: pa.Array, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """What the lists of ``words`` have, in order: the distinct words, each word's place there, its list, and where a pair of neighbours begins."""
    coded = words.dictionary_encode()
    codes, of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    return coded.dictionary, codes, of, np.flatnonzero(of[1:] == of[:-1])


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _tallied(texts: DataFrame, least: int) -> DataFrame:
    """term, low, pieces: over all pieces (Arrow batches) of ``texts`` (t), how often terms occur in those that have them ``least`` times, and how many those are; the row of the null term counts all pieces."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes, _, pairs = _occurrences(*_lists(batch.column(0)))
            n = len(words)
            keys, low = np.unique(np.concatenate([codes, n + codes[pairs] * n + codes[pairs + 1]]), return_counts=True)
            keys, low = keys[low >= least], low[low >= least]
            one = keys < n
            first, second = np.divmod(keys[~one] - n, max(n, 1))
            both = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
            terms = pa.concat_arrays([words.take(pa.array(keys[one])).cast(pa.string()), both.cast(pa.string()), pa.nulls(1, pa.string())])
            low = np.concatenate([low[one], low[~one], [0]])
            yield pa.RecordBatch.from_arrays([terms, pa.array(low, pa.int64())], ["term", "low"])

    return texts.select("t").mapInArrow(tally, "term string, low long").groupBy("term").agg(F.sum("low").alias("low"), F.count(F.lit(1)).alias("pieces"))


def _candidates(texts: DataFrame, pieces: int, max_features: int) -> list[str]:
    """Terms among which the ``max_features`` most frequent ones are, at most four times as many.

    Terms that a piece has once need not leave it: what is counted then is at most one less a piece than there is. The least of the best counts tells who may
    still be among the best, and whether a term may that no piece has twice; if so, or if too many may, everything is counted.
    """
    if pieces >= PIECES:
        found = keep(_tallied(texts, 2))
        all_pieces = found.filter("term IS NULL").first()
        best = found.filter("term IS NOT NULL").orderBy(F.desc("low")).limit(max_features).agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).first()
        if all_pieces and best["n"] == max_features and best["low"] > all_pieces["pieces"]:
            rows = found.filter("term IS NOT NULL").filter(F.col("low") + all_pieces["pieces"] - F.col("pieces") >= best["low"]).select("term").limit(4 * max_features + 1).collect()
            if len(rows) <= 4 * max_features:
                return sorted(r["term"] for r in rows)
    rows = _tallied(texts, 1).filter("term IS NOT NULL").orderBy(F.desc("low"), "term").limit(max_features).select("term").collect()
    return sorted(r["term"] for r in rows)


def _counted(texts: DataFrame, terms: list[str]) -> DataFrame:
    """doc, ids, n: for each row of ``texts`` (doc, t) the places in ``terms`` of those it has, and how often."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [t.split(" ") for t in terms]
        words = pa.array(sorted({w for s in split for w in s}), pa.string())
        place = {w: i for i, w in enumerate(words.to_pylist())}
        single = np.full(len(words) + 1, -1)
        pairs = {place[s[0]] * len(words) + place[s[1]]: i for i, s in enumerate(split) if len(s) == 2}
        for i, s in enumerate(split):
            if len(s) == 1:
                single[place[s[0]]] = i
        known = np.array(sorted(pairs) + [np.iinfo(np.int64).max])
        pair_ids = np.array([pairs[k] for k in known[:-1].tolist()] + [-1])
        for batch in batches:
            own, codes, of, begins = _occurrences(*_lists(batch.column(1)))
            at = pc.fill_null(pc.index_in(own.cast(pa.string()), value_set=words), len(words)).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            first, second = at[begins], at[begins + 1]
            keys = np.where((first < len(words)) & (second < len(words)), first * len(words) + second, -1)
            found = np.searchsorted(known, keys)
            ids = np.concatenate([single[at], np.where(known[found] == keys, pair_ids[found], -1)])
            rows = np.concatenate([of, of[begins]])
            cells, n = np.unique((rows * len(terms) + ids)[ids >= 0], return_counts=True)
            rows, ids = np.divmod(cells, max(len(terms), 1))
            ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc", "ids", "n"])

    return texts.mapInArrow(counts, f"doc {texts.schema['doc'].dataType.simpleString()}, ids array<int>, n array<int>")


def build_index(docs: DataFrame, doc: str = "doc", text: str = "text", max_features: int = 50_000) -> Index:
    """The index of ``docs``. Texts move once, their many terms don't: they are counted in Arrow batches where the text is; the counts of known terms are written, a row for each document.

    More than ``TERMS`` features are counted by joins.
    """
    docs = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    n = keep(docs.select("doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("most")))
    pieces = _pieces(docs)
    docs, counted, shared = docs.repartition(pieces, "doc"), None, (n.first()["most"] or 0) > 1
    if max_features <= TERMS:
        texts = docs.select("doc", tokenized(F.col("text")).alias("t"))
        terms = _candidates(texts, pieces, max_features)
        listed = keep(docs.sparkSession.createDataFrame(list(enumerate(terms)), "id int, term string"))
        counted = keep(_counted(texts, terms))
        rows = counted.repartition("doc").select("doc", F.explode(F.arrays_zip("ids", "n")).alias("c")).select("doc", F.col("c.ids").alias("id"), "c.n")
        if shared:  # rows have a document in common
            rows = rows.groupBy("doc", "id").agg(F.sum("n").alias("n"))
        df = rows.groupBy("id").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).join(F.broadcast(listed), "id")
        key, columns = "id", ["id", "term"]
    else:
        rows = term_counts(docs)
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
        key, columns = "term", ["term"]
    df = df.orderBy(F.desc("total"), "term").limit(max_features)
    idf = keep(df.join(F.broadcast(n)).select(*columns, (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")))  # n is one row
    known = F.broadcast(idf) if max_features <= TERMS else idf
    weights = rows.join(known, key).select("doc", "term", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    norms = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return Index(weights, norms, idf.select("term", "idf"), *((counted, idf) if counted is not None and not shared else ()))


def scaled(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """doc, term, w: weights of known terms, each document's scaled to length 1."""
    w = counts.join(idf, "term").select("doc", "term", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


#: Numbers that a scoring task holds at once, about, and documents that it takes at once.
CELLS, ROWS = 1_000_000, 1000
#: Scores are rounded after the best of a task are chosen, so those within this of them stay, too.
NEAR = 2e-6


def _best(index: Index, q: DataFrame, top_k: int) -> DataFrame:
    """query, doc, score (not rounded): of each task the documents that may be among the ``top_k`` of a query (query, term, wq) by their score."""
    asked = keep(q.select("query").distinct().coalesce(1).withColumn("at", F.monotonically_increasing_id()))
    cells = [tuple(r) for r in q.join(asked, "query").join(index.places, "term").select("at", "id", "wq").collect()]  # at most TERMS rows
    idf, many = {r["id"]: r["idf"] for r in index.places.select("id", "idf").collect()}, asked.count()  # at most TERMS rows

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_id = np.zeros(max(idf, default=0) + 2)  # what isn't known weighs nothing
        of_id[list(idf)] = list(idf.values())
        column, term, weight = (np.array(x, kind) for x, kind in zip(list(zip(*cells, strict=True)) or [[], [], []], (np.int64, np.int64, np.float64), strict=True))
        wanted = np.unique(term)
        place = np.full(len(of_id), -1)
        place[wanted] = np.arange(len(wanted))
        wide = max(1, min(many, CELLS // max(1, len(wanted))))
        floor = np.zeros(many)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            docs, (ids, lengths) = batch.column(0), _lists(batch.column(1))
            ids = np.minimum(ids.to_numpy(zero_copy_only=False).astype(np.int64), len(of_id) - 1)
            w = (1 + np.log(batch.column(2).flatten().to_numpy(zero_copy_only=False))) * of_id[ids]
            of = np.repeat(np.arange(len(docs)), lengths)
            norm = np.sqrt(np.bincount(of, w * w, len(docs)))
            held = np.flatnonzero((place[ids] >= 0) & (w > 0))
            of, at, w = of[held], place[ids[held]], w[held]
            out = []
            for left in range(0, many, wide):
                table = np.zeros((len(wanted), min(wide, many - left)))
                own = (column >= left) & (column < left + wide)
                table[place[term[own]], column[own] - left] = weight[own]
                begin = 0
                while begin < len(of):
                    end = min(len(of), begin + max(1, CELLS // table.shape[1]))
                    if end < len(of):  # a document is scored whole
                        end = np.searchsorted(of, of[end]) if of[end] > of[begin] else np.searchsorted(of, of[begin], "right")
                    rows, first = np.unique(of[begin:end], return_index=True)
                    found = np.add.reduceat(table[at[begin:end]] * w[begin:end, None], first, axis=0) / norm[rows, None]
                    low = floor[left : left + table.shape[1]]
                    if len(rows) >= top_k:
                        np.maximum(low, np.partition(found, -top_k, axis=0)[-top_k], out=low)
                    r, c = np.nonzero((found > 0) & (found >= low - NEAR))
                    out.append((rows[r], c + left, found[r, c]))
                    begin = end
            for rows, c, found in out:
                own = found >= floor[c] - NEAR
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(rows[own], pa.int64())), pa.array(c[own], pa.int64()), pa.array(found[own], pa.float64())], ["doc", "at", "score"])

    found = index.counts.mapInArrow(scored, f"doc {index.counts.schema['doc'].dataType.simpleString()}, at long, score double")
    return found.join(F.broadcast(asked), "at").select("query", "doc", "score")


def search(index: Index, queries: DataFrame, top_k: int = 5, query: str = "query", text: str = "text") -> DataFrame:
    """query, doc, score, rank: the best ``top_k`` documents of each query; ties go to the smaller document.

    Where documents' counts are rows and queries' terms few, each task scores its documents and gives on the best ones only.
    """
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    q = keep(scaled(term_counts(queries, query, text), index.idf).select(F.col("doc").alias("query"), "term", F.col("w").alias("wq")))
    few = q.count() <= TERMS
    if few and index.counts is not None:
        scores = _best(index, q, top_k).withColumn("score", F.round("score", 6))
    else:
        # Only terms of queries count, so they meet the weights first, and lengths what is left.
        sums = index.weights.join(F.broadcast(q) if few else q, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("wq")).alias("sum"))
        # The norms of a task's documents are its hash table, so that the many sums needn't be sorted.
        scores = sums.join(index.norms.hint("shuffle_hash"), "doc").select("query", "doc", F.round(F.col("sum") / F.col("norm"), 6).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc")))
    return ranked.filter((F.col("rank") <= top_k) & (F.col("score") > 0))


def checked_query(text: str) -> str:
    """The query without outer blanks; ValueError if it is blank or longer than ``MAX_QUERY``."""
    text = text.strip()
    if not 1 <= len(text) <= MAX_QUERY:
        raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
    return text


def search_one(index: Index, text: str, top_k: int = 5) -> DataFrame:
    """doc, score, rank for a single query: checked, and with its CJK characters set apart."""
    spark = index.idf.sparkSession
    query = spark.createDataFrame([(0, checked_query(text))], "query long, text string").withColumn("text", spaced_cjk(F.col("text")))
    return search(index, query, top_k).drop("query")


def top_terms(index: Index, n: int = 10) -> DataFrame:
    """doc, term, rank: the heaviest terms of each document."""
    order = W.partitionBy("doc").orderBy(F.desc(F.round("w", 9)), "term")
    return index.postings.filter("w > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("doc", "term", "rank")


def hit_rate(found: DataFrame, truth: DataFrame) -> DataFrame:
    """queries, top1, top3: shares of queries whose expected document (query, expected) is first, or among three."""
    j = truth.join(found, (truth["query"] == found["query"]) & (truth["expected"] == found["doc"]), "left").select(truth["query"], "rank")
    j = j.groupBy("query").agg(F.min("rank").alias("rank"))
    share = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return j.agg(F.count(F.lit(1)).alias("queries"), share(1).alias("top1"), share(3).alias("top3"))
