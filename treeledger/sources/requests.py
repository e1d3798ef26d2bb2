"""The request log: one row a request, and the bodies that requests brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.paths import encode_component, join_address

SCHEMA = (
    "seq bigint, ts timestamp, kind string, method string, url string, range string, status int, final_url string, redirected boolean, elapsed_ms bigint, "
    "req_headers map<string,string>, resp_headers map<string,string>, bytes_in bigint, stored_as string, attempts int"
)


#: Endpoints that are sent to every task, and letters by which more of them are looked up.
FEW, PREFIX = 1000, 12


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def write_log(log: DataFrame, path: str) -> None:
    log.orderBy("seq").write.json(path)


def retryable(status: Column, retcode: Column | None = None, terminal: list[int] | None = None) -> Column:
    """Whether another attempt could help."""
    again = status.isin(408, 429) | status.between(500, 599)
    return again & ~retcode.isin(terminal) if retcode is not None and terminal else again


def match_bodies(bodies: DataFrame, log: DataFrame) -> DataFrame:
    """endpoint and the seq of the last good request whose URL contains it, 0 without one.

    A few endpoints go to every task. Of more, each is looked up by its first letters, as many as the shortest one has
    (PREFIX at most), among the runs of so many letters of the distinct URLs; an empty endpoint is in every URL.
    """
    few = bodies.select("endpoint").distinct()
    # of repeated URLs the last request counts, so each is searched once
    good = log.where("status = 200").groupBy("url").agg(F.max("seq").alias("seq"))
    known = few.agg(F.count("*").alias("n"), F.min(F.when(F.col("endpoint") != "", F.length("endpoint"))).alias("letters")).first()
    if known["n"] <= FEW:
        hit = good.join(F.broadcast(few), F.expr("contains(url, endpoint)"))
    else:
        n = min(PREFIX, known["letters"])
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("url") - n + 1), lambda i: F.substring("url", i, F.lit(n))))
        places = good.where(F.length("url") >= n).select("url", "seq", F.explode(runs).alias("run"))
        hit = places.join(few.where("endpoint <> ''").withColumn("run", F.substring("endpoint", 1, n)), "run").where("contains(url, endpoint)").select("endpoint", "seq")
        everywhere = good.agg(F.max("seq").alias("seq")).where("seq is not null").select(F.lit("").alias("endpoint"), "seq")
        hit = hit.unionByName(everywhere)
    last = hit.groupBy("endpoint").agg(F.max("seq").alias("seq"))
    return bodies.select("endpoint").join(last, "endpoint", "left").select("endpoint", F.coalesce("seq", F.lit(0)).alias("seq"))


def envelope(bodies: DataFrame, data_schema: str) -> DataFrame:
    """name, retcode, message, data of stored JSON answers (name, body); answers() refuses those that failed."""
    parsed = F.from_json("body", f"struct<retcode:int,message:string,data:{data_schema}>")
    return bodies.select("name", parsed.alias("p")).select("name", "p.retcode", "p.message", "p.data")


def answers(bodies: DataFrame, data_schema: str) -> DataFrame:
    """name, data of the answers; one without retcode 0 makes them all worthless, so it raises."""
    read = envelope(bodies, data_schema)
    why = F.concat(F.col("name"), F.lit(": retcode "), F.coalesce(F.col("retcode").cast("string"), F.lit("absent")), F.lit(" "), F.coalesce("message", F.lit("")))
    return read.select("name", F.when(F.coalesce(F.col("retcode") == 0, F.lit(False)), F.col("data")).otherwise(F.raise_error(why)).alias("data"))


def node(nodes: DataFrame, name: str) -> DataFrame:
    """The one node of that name; none or several raise."""
    found = nodes.where(F.col("name") == name)
    n = found.count()
    if n != 1:
        raise ValueError(f"{n} nodes named {name} instead of one")
    return found


def by_kind(log: DataFrame) -> DataFrame:
    """kind, requests, bytes_in, last_seq of a log."""
    return log.groupBy("kind").agg(F.count("*").alias("requests"), F.sum(F.coalesce("bytes_in", F.lit(0))).alias("bytes_in"), F.max("seq").alias("last_seq"))


def service_url(base: Column, path: Column, launcher: Column, language: Column, game: Column, channel: Column | None = None, sub_channel: Column | None = None) -> Column:
    """Address of a launcher query; channels only where the endpoint takes them. The key game_ids[] stays as it is."""
    pair = lambda name, value: F.concat(F.lit(f"{name}="), encode_component(value))
    asked = [F.concat(F.lit("launcher_id="), launcher), pair("language", language), pair("game_ids[]", game)]
    asked += [pair(n, c) for n, c in (("channel", channel), ("sub_channel", sub_channel)) if c is not None]
    return F.concat(join_address(base, path), F.lit("?"), F.concat_ws("&", *asked))


def build_url(base: Column, branch: Column, package: Column, password: Column, tag: Column | None = None) -> Column:
    """Address of a build; without a tag (or where it is null) that of the branch's head."""
    pair = lambda name, value: F.concat(F.lit(f"{name}="), encode_component(value))
    asked = [pair("branch", branch), pair("package_id", package), pair("password", password)]
    if tag is not None:
        asked.append(F.when(tag.isNotNull(), pair("tag", tag)))
    return F.concat(join_address(base, F.lit("getBuild")), F.lit("?"), F.concat_ws("&", *asked))


def addressed(asked: DataFrame, regions: DataFrame, path: Column, language: Column, with_channels: Column) -> DataFrame:
    """asked with `url`, the address of a launcher query of its region; a region that the table lacks raises.

    regions: region, base, launcher_id, game_id, channel, sub_channel, a few rows that the caller keeps.
    """
    one = regions.groupBy("region").agg(*[F.first(c).alias(c) for c in ("base", "launcher_id", "game_id", "channel", "sub_channel")], F.count("*").alias("times"))
    found = asked.join(one, "region", "left")
    url = F.when(with_channels, service_url(F.col("base"), path, F.col("launcher_id"), language, F.col("game_id"), F.col("channel"), F.col("sub_channel"))).otherwise(service_url(F.col("base"), path, F.col("launcher_id"), language, F.col("game_id")))
    why = F.when(F.col("times").isNull(), F.concat(F.lit("no region "), F.coalesce("region", F.lit("null")))).when(F.col("times") > 1, F.concat("region", F.lit(" is listed twice")))
    return found.select(*asked.columns, F.when(why.isNotNull(), F.raise_error(why)).otherwise(url).alias("url"))
