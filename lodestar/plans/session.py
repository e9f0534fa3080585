"""A command façade: one text command at a time, or a batch of lines, against a set of objects.

Commands read and change a session's settings and return DataFrames or texts. Commands that change settings return "ok".
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.distances import distance
from lodestar.operators import named as N
from lodestar.operators import retrieval as R
from lodestar.operators import sparse as SP
from lodestar.sources.formats import parse_lambdas, parse_weights, read_filelist, write_ranks

HELP = "retrieve expand metaretrieve metaexpand textretrieve textexpand savedistances retrieveandsaveranks saverelevances class random listfiles filelist image feature info metafeatureinfo setdist setweight weight setresults setextensions setscoring setcombiner interactor setfilter help"


@dataclass
class Session:
    """``objects`` has idx, name, class and feature columns; ``features`` are (column, distance specification)."""

    objects: DataFrame
    features: list[tuple[str, str]]
    weights: list[float] = field(default_factory=list)
    results: int = 10
    extensions: int = 0
    interactor: str = ""
    combiner: str = "scoresum"
    stages: list[tuple[int, int]] = field(default_factory=list)
    meta_column: str | None = None
    texts: DataFrame | None = None
    relevances: list[str] = field(default_factory=list)
    relevance_path: str = ""
    scoring: str = "linear"

    def __post_init__(self) -> None:
        self.weights = self.weights or [1.0] * len(self.features)

    @property
    def spark(self):
        return self.objects.sparkSession

    def _features(self):
        return [(c, distance(spec)) for c, spec in self.features]

    def _queries(self, names: Iterable[str]) -> DataFrame:
        rows = [(0, n.lstrip("+-"), -1 if n.startswith("-") else 1) for n in names]
        return R.resolve_names(self.spark.createDataFrame(rows, "qid int, name string, sign int"), self.objects)

    def _scores(self, asked: DataFrame) -> DataFrame:
        """(qid, sign, q, idx, s) by the session's distances, interactor and scoring."""
        dist = R.interact(R.normalize(N.distances(self.objects, asked, self.features)), self.interactor)
        kind, _, config = self.scoring.partition(":CONFIG=")
        if kind == "linear":
            return R.scored(dist, R.linear, parse_weights(self._text(config)) if config else self.weights)
        if kind == "svm":
            *weights, bias = parse_weights(self._text(config))
            return R.scored(dist, R.svm_score, weights, bias)
        return R.scored(dist, R.SCORERS[kind], **parse_lambdas(self._text(config)))

    def _text(self, path: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(path).collect())

    def _extended(self, results: DataFrame) -> DataFrame:
        """With extensions, the best results are the only, positive examples of a second pass; their scores add up."""
        if not self.extensions:
            return results
        again = R.top(results, self.extensions).select("qid", "idx", F.lit(1).alias("sign"))
        return self._scores(again).groupBy("qid", "idx").agg(F.sum("s").alias("score"))

    def retrieve(self, names: Iterable[str]) -> DataFrame:
        """(qid, idx, score) of all objects for examples ``name``, ``+name`` and ``-name``."""
        asked = self._queries(names)
        if self.stages:
            return R.cascade(self.objects, asked, self.stages, self._features(), self.weights)
        return self._extended(R.COMBINERS[self.combiner](self._scores(asked)))

    def metaretrieve(self, words: Iterable[str]) -> DataFrame:
        """(qid, idx, score) of objects by ``key:value,key:value``."""
        wanted = dict(x.split(":", 1) for x in " ".join(words).split(",") if ":" in x)
        return self._extended(SP.meta_scores(self.objects, self.meta_column, wanted).withColumn("qid", F.lit(0)))

    def textretrieve(self, words: Iterable[str]) -> DataFrame:
        """(qid, idx, score) of documents that share words with the text, or by language with ``En:"..." Fr:"..."`` (texts with a column lang)."""
        query = " ".join(words)
        tf, parts = SP.terms(self.texts, "idx", F.col("text")), SP.language_parts(query)
        if parts:
            rows = self.spark.createDataFrame([(0, lang, text) for lang, text in parts], "q int, lang string, text string")
            asked = SP.terms(rows.withColumn("q", F.struct("q", "lang")), "q", F.col("text")).select("id.q", "id.lang", "term", "tf")
            found = SP.text_scores(tf, asked, self.texts.select(F.col("idx").alias("id"), F.lower("lang").alias("lang")))
        else:
            found = SP.text_scores(tf, SP.terms(self.spark.createDataFrame([(0, query)], "q int, text string"), "q", F.col("text")).withColumnRenamed("id", "q"))
        return self._extended(found.select(F.col("q").alias("qid"), F.col("id").alias("idx"), "score"))

    def _named(self, results: DataFrame, step: int = 0) -> DataFrame:
        return R.page(results, step, self.results).join(self.objects.select("idx", "name"), "idx").select("rank", "name", "score").orderBy("rank")

    def command(self, line: str):
        """The result of one command line."""
        name, *rest = line.split() or [""]
        if name == "retrieve":
            return self._named(self.retrieve(rest))
        if name == "expand":
            return self._named(self.retrieve(rest[1:]), int(rest[0]))
        if name in ("metaretrieve", "textretrieve"):
            return self._named(getattr(self, name)(rest))
        if name in ("metaexpand", "textexpand"):
            return self._named(getattr(self, name.replace("expand", "retrieve"))(rest[1:]), int(rest[0]))
        if name == "savedistances":
            R.save_distances(R.normalize(N.distances(self.objects, self._queries(rest[:1]), self.features)), rest[1])
            return "ok"
        if name == "retrieveandsaveranks":
            write_ranks(R.top(self.retrieve(rest[2:]), int(rest[0])).join(self.objects.select("idx", "name"), "idx"), rest[1], line)
            return "ok"
        if name == "saverelevances":
            self.relevances.append(line)
            if self.relevance_path:
                self.spark.createDataFrame([(line,)], "value string").write.mode("append").text(self.relevance_path)
            return "ok"
        if name == "class":
            return self.objects.where(F.col("name") == rest[0]).select("class")
        if name == "random":
            return self.objects.orderBy(F.rand()).select("name").limit(int(rest[0]) if rest else self.results)
        if name == "listfiles":
            return self.objects.orderBy("idx").select("name")
        if name == "feature":
            return self.objects.where(F.col("name") == rest[0]).select("name", rest[1])
        if name == "image":
            return self.objects.where(F.col("name") == rest[0])
        if name == "metafeatureinfo":
            return SP.meta_keys(self.objects, self.meta_column)
        if name == "info":
            return {"size": self.objects.count(), "results": self.results, "extensions": self.extensions, "combiner": self.combiner, "scoring": self.scoring, "interactor": self.interactor, "features": [(c, d, w) for (c, d), w in zip(self.features, self.weights, strict=True)]}
        if name == "weight":
            return self.weights[int(rest[0])]
        if name == "help":
            return HELP
        return self._set(name, rest)

    def _set(self, name: str, rest: list[str]) -> str:
        if name == "setdist":
            column = self.features[int(rest[0])][0]
            N.check(self.objects, column, rest[1])
            self.features[int(rest[0])] = (column, rest[1])
        elif name == "setweight":
            self.weights[int(rest[0])] = float(rest[1])
        elif name == "setresults":
            self.results = int(rest[0])
        elif name == "setextensions":
            self.extensions = int(rest[0])
        elif name == "setcombiner" or name == "setscoring" and rest[0] in R.COMBINERS:
            if rest[0] not in R.COMBINERS:
                raise ValueError(f"unknown combiner {rest[0]!r}")
            self.combiner = rest[0]
        elif name == "setscoring":
            kind, _, config = rest[0].partition(":CONFIG=")
            if kind not in R.SCORERS or kind != "linear" and not config:
                raise ValueError(f"unknown scoring {rest[0]!r}; known: {' '.join(R.SCORERS)}, with :CONFIG=file but for linear")
            self.scoring = rest[0]
        elif name == "filelist":
            # The objects are those that the list names, numbered in its order, with its classes.
            listed = read_filelist(self.spark, rest[0]).table(self.spark).select(F.col("idx").alias("_i"), "name", F.col("class").alias("_c"))
            known = self.objects.join(listed, "name")
            self.objects = known.select(F.col("_i").alias("idx"), "name", F.coalesce("_c", "class").alias("class"), *[c for c in self.objects.columns if c not in ("idx", "name", "class")])
        elif name == "interactor":
            self.interactor = rest[0] if rest else ""
        elif name == "setfilter":
            self.stages = [tuple(map(int, x.split(":"))) for x in rest[0].split("-")] if rest else []
        else:
            raise ValueError(f"unknown command {name!r}")
        return "ok"

    def batch(self, lines: Iterable[str]) -> list:
        """One command a line; empty lines and comments are skipped."""
        return [self.command(x) for x in lines if x.strip() and not x.lstrip().startswith("#")]
