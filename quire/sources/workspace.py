"""Stage tables of one run in one folder, with small JSON side files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.errors import GraphVersionError, IndexTableError, StageError
from quire.operators.retrieval_graph import VERSION
from quire.schemas import SPAN, struct


class Workspace:
    """Tables are Parquet folders; any file system Spark can reach will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def _recover(self, name: str) -> None:
        """Finish a table switch that was interrupted: the old table comes back if no new one is in place."""
        fs, table = self._fs(self.path(name))
        _, kept = self._fs(self.path(f"{name}.old"))
        if fs.exists(kept):
            if fs.exists(table):
                fs.delete(kept, True)
            else:
                fs.rename(kept, table)

    def save(self, name: str, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Write a stage table and return it as read back.

        The rows go to a side folder first, so a stage may rewrite a table it reads. The old
        table is moved aside until the new one is in place: at every moment one of them is whole,
        and the next access puts it back if the switch was cut short.
        """
        self._recover(name)
        fresh = self.path(f"{name}.new")
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(fresh)
        fs, new = self._fs(fresh)
        _, old = self._fs(self.path(name))
        _, aside = self._fs(self.path(f"{name}.old"))
        if fs.exists(old) and not fs.rename(old, aside):
            raise StageError(f"cannot move {self.path(name)} aside")
        if not fs.rename(new, old):
            self._recover(name)
            raise StageError(f"cannot move {fresh} into place")
        if fs.exists(aside):
            fs.delete(aside, True)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def append(self, name: str, df: DataFrame, by: list[str]) -> None:
        df.write.mode("append").partitionBy(*by).parquet(self.path(name))

    def load(self, name: str, *, schema: str | None = None) -> DataFrame:
        """A stage table; where it is absent, an empty one if a schema is given."""
        self._recover(name)
        if not self.exists(name):
            if schema is None:
                raise StageError(f"table {name} is missing in {self.folder}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def write_json(self, name: str, value: dict[str, Any]) -> None:
        fs, p = self._fs(self.path(name))
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
        out.close()

    def read_json(self, name: str) -> dict[str, Any]:
        text = self.spark.read.text(self.path(name), wholetext=True).first()[0]
        return json.loads(text)

    # ---- particular tables ---------------------------------------------------------

    def save_index(self, cards: DataFrame, dim: int, metric: str) -> DataFrame:
        """Card table with vectors, split by card type so searches prune whole folders."""
        table = self.save("index", cards, by=["evidence_type"])
        wrong = table.filter(F.size("vector") != dim).limit(1).count()
        if wrong:
            raise IndexTableError(f"a card vector does not have {dim} entries")
        self.write_json("index.meta.json", {"dim": dim, "metric": metric})
        return table

    def load_index(self, dim: int | None = None) -> DataFrame:
        if not self.exists("index"):
            raise IndexTableError(f"no card index in {self.folder}; run the build first")
        have = self.read_json("index.meta.json")["dim"]
        if dim is not None and have != dim:
            raise IndexTableError(f"index holds {have} entries per vector, the recipe asks for {dim}")
        return self.load("index")

    def save_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.save("retrieval_nodes", nodes)
        self.save("retrieval_edges", edges)
        self.write_json("retrieval_graph.json", {"version": VERSION})

    def load_graph(self) -> tuple[DataFrame, DataFrame]:
        if not self.exists("retrieval_graph.json"):
            raise StageError("no retrieval graph; build with the retrieval_graph stage")
        version = self.read_json("retrieval_graph.json").get("version")
        if version != VERSION:
            raise GraphVersionError(f"retrieval graph has version {version}, expected {VERSION}")
        return self.load("retrieval_nodes"), self.load("retrieval_edges")

    def append_spans(self, rows: list[dict[str, Any]]) -> None:
        """Append a few finished spans to the JSON-lines trace."""
        if rows:
            names = struct(SPAN).names
            data = [tuple(r.get(n) for n in names) for r in rows]
            self.spark.createDataFrame(data, SPAN).coalesce(1).write.mode("append").json(self.path("trace"))

    def spans(self) -> DataFrame:
        """Every timing span of every invocation."""
        if not self.exists("trace"):
            return self.spark.createDataFrame([], SPAN)
        return self.spark.read.schema(SPAN).json(self.path("trace")).filter("type = 'stage_timing'")


def export_lines(df: DataFrame, path: str) -> None:
    """JSON-lines export of any table."""
    df.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str, question: str = "question", qid: str = "qid") -> DataFrame:
    """Question file -> (qid, question, answer_guidelines); rows without a question are skipped.

    Only declared fields are read. A missing id becomes a hash of the question.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in dict.fromkeys([qid, question, "answer_guidelines"])])
    rows = spark.read.schema(schema).json(path)
    text = F.col(question)
    ident = F.coalesce(F.col(qid), F.substring(F.sha2(text, 256), 1, 12))
    return rows.filter(F.coalesce(F.trim(text), F.lit("")) != "").select(
        ident.alias("qid"), text.alias("question"), "answer_guidelines"
    )


def write_answers(answers: DataFrame, path: str) -> None:
    fields = ["qid", "question", "answer", "cited_pages", "confidence", "answer_mode", "route"]
    answers.select(*fields).write.mode("overwrite").json(path)
