"""Token counts as delta-maintained rollups.

A store is a log of committed batches and the totals that they have been added to. A batch holds signed deltas, summed by
(source, lang, tokenizer_version). Its sums are written aside; the commit is one numbered file in the log, which one writer
gets: whoever finds the number taken reads what has come and starts again, and a batch whose id has come, by a retry, by
mistake or by another writer at the same time, changes nothing. A commit then adds what is new in the log to the last totals
and writes them as new ones, named by the log's number that they reach, so that what they hold is one number; batches beyond
it (a writer was lost, or another was faster) are added when totals are read, and by the next commit. The ids up to
that number have a file each, so that an old id is found without a list of all.

A delta is (source, lang, tokenizer_version, n_tokens, sign): +1 inserts a document's count, -1 takes it back; a revised
count is both. Null source and lang are groups of their own. Groups whose documents and tokens are all taken back don't
appear. An empty batch commits and adds nothing; extra columns of documents play no part; a null text has 0 tokens; an empty
table of documents has no counts; a batch's id may hold any characters.
"""

from __future__ import annotations

import base64
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import hadoop, names, put_if_absent, read_small
from .common import bounded, cut, lean, shared_dir, ship, table

KEYS = ("source", "lang", "tokenizer_version")
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class RollupStore:
    """Folders: log/<number> (batch, data), ids/<id> (number), totals/<number> (data), data/<name> (sums)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _get(self, name: str) -> dict | None:
        text = read_small(self.spark, f"{self.folder}/{name}")
        return None if text is None else json.loads(text)

    def _put(self, name: str, what: dict) -> bool:
        return put_if_absent(self.spark, f"{self.folder}/{name}", json.dumps(what))

    def _delete(self, name: str) -> None:
        fs, p = hadoop(self.spark, f"{self.folder}/{name}")
        fs.delete(p, True)

    def _sums(self, deltas: DataFrame) -> str:
        data = uuid.uuid4().hex
        deltas.write.parquet(f"{self.folder}/data/{data}")
        return data

    def _last(self) -> tuple[int, str | None]:
        """The log's number that the last totals reach (0: there are none), and their data."""
        numbers = [int(n) for n in names(self.spark, f"{self.folder}/totals") if n.isdigit()]
        return (max(numbers), self._get(f"totals/{max(numbers):012}")["data"]) if numbers else (0, None)

    def _beyond(self, number: int) -> list[dict]:
        """Log entries after a number, as far as they go."""
        out = []
        while e := self._get(f"log/{number + len(out) + 1:012}"):
            out.append(e)
        return out

    def committed(self, batch: str) -> bool:
        # the totals' number first: ids up to it have their files
        beyond = self._beyond(self._last()[0])
        return any(e["batch"] == batch for e in beyond) or self._get(f"ids/{_name(batch)}") is not None

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False if one of this id is there already, and nothing changes then."""
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        data = self._sums(sums)
        while True:
            number = self._last()[0]
            beyond = self._beyond(number)
            if any(e["batch"] == batch for e in beyond) or self._get(f"ids/{_name(batch)}"):
                self._delete(f"data/{data}")
                return False
            if self._put(f"log/{number + len(beyond) + 1:012}", {"batch": batch, "data": data}):
                break
        self.add_up()
        return True

    def _current(self) -> tuple[int, list[dict], DataFrame]:
        """Number of the last totals, log entries beyond, and the sums of all."""
        number, data = self._last()
        beyond = self._beyond(number)
        found = [d for d in (data, *(e["data"] for e in beyond)) if d]
        if not found:
            return number, beyond, self.spark.createDataFrame([], _SCHEMA)
        all_ = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.folder}/data/{d}" for d in found])
        return number, beyond, all_.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def add_up(self) -> None:
        """Write new totals that reach the log's end; the last ones but one go."""
        number, beyond, sums = self._current()
        if not beyond:
            return
        for k, e in enumerate(beyond, number + 1):
            self._put(f"ids/{_name(e['batch'])}", {"number": k})
        data = self._sums(sums)
        if not self._put(f"totals/{number + len(beyond):012}", {"data": data}):
            self._delete(f"data/{data}")
        for n in names(self.spark, f"{self.folder}/totals"):
            if n.isdigit() and int(n) < number and (old := self._get(f"totals/{n}")):
                self._delete(f"totals/{n}")
                self._delete(f"data/{old['data']}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches."""
        return self._current()[2].where("n_docs <> 0 or n_tokens <> 0")


def _name(batch: str) -> str:
    """A batch's id as a file name: letters, digits and hyphens as they are, else by code."""
    return "b" + "".join(c if c.isascii() and (c.isalnum() or c == "-") else f"_{ord(c):x}_" for c in batch)


def vocabulary(version: str) -> str:
    """File of a tokenizer version: a tiktoken rank file's name."""
    import public_tokenizers

    return public_tokenizers.path(f"{version}.tiktoken")


def count_tokens(docs: DataFrame, version: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs (doc_id, source, lang, text) without the text, with tokenizer_version and n_tokens."""
    import public_tokenizers

    path, pattern = path or vocabulary(version), pattern or public_tokenizers.PATTERN

    @lean
    def batches(it):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in it:
            n = [len(encode(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "lang": pdf["lang"], "n_tokens": n})

    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return d.mapInPandas(batches, "doc_id long, source string, lang string, n_tokens long").withColumn("tokenizer_version", F.lit(version))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document inserted under one tokenizer, those labelled toxic deleted, the other good ones revised to a second tokenizer; each batch committed twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = RollupStore(spark, f"{shared_dir(spark)}/tidewrack/rollups-{uuid.uuid4().hex}")
    first = cut(count_tokens(docs, "byte_bpe_50k"), "counts")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    toxic, good = marks.where("toxic = 1").select("id"), marks.where("quality = 1 and coalesce(toxic, 0) <> 1").select("id")
    of = lambda d, ids: d.join(F.broadcast(ids) if bounded(ids) else ids, d.doc_id == F.col("id"), "left_semi")
    second = count_tokens(of(docs, good), "byte_bpe_multi_50k")
    signed = lambda d, sign: d.select(*KEYS, "n_tokens", F.lit(sign).alias("sign"))
    for _ in range(2):
        store.commit("1-load", signed(first, 1))
        store.commit("2-toxic", signed(of(first, toxic), -1))
        store.commit("3-revise", signed(of(first, good), -1).unionByName(signed(second, 1)))
    return store.totals()
