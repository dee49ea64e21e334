"""Addresses of hosts that many companies share, without a row for every company and address.

A host of m companies with a addresses stands for m * a rows of the address
table. Here it is m members and a addresses; counts, the merge with a store and
totals are worked out from the two, and rows are made only where asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import storage_key
from ..session import written
from .skew import grid_join, hot_keys, salted_join

PAIR = ["company_id", "email"]


@dataclass(frozen=True)
class SharedRows:
    """``members`` (company_id, domain) times ``addresses`` (domain, email), but for the pairs in ``known`` (company_id, email)."""

    members: DataFrame
    addresses: DataFrame
    known: DataFrame | None = None

    @staticmethod
    def of(targets: DataFrame, addresses: DataFrame) -> SharedRows:
        """From companies with their domain and addresses by domain, in the form they are stored in; both written once."""
        stored = addresses.select("domain", storage_key(F.col("email")).alias("email")).filter("domain is not null and email is not null")
        return SharedRows(
            written(targets.select("company_id", "domain").filter("domain is not null").distinct(), "shared-members"),
            written(stored.distinct(), "shared-addresses"),
        )

    def _hot(self) -> list:
        return hot_keys(self.members, "domain")

    def without(self, stored: DataFrame) -> SharedRows:
        """All pairs a store does not hold: its own that lie in the product are named, nothing is multiplied."""
        own = stored.select(*PAIR).join(self.members, "company_id")
        known = own.join(self.addresses, ["domain", "email"], "left_semi").select(*PAIR).distinct()
        known = known if self.known is None else known.unionByName(self.known).distinct()
        return replace(self, known=written(known, "shared-known"))

    def sizes(self) -> DataFrame:
        """(domain, n_members, n_addresses) of the domains that have both."""
        members = self.members.groupBy("domain").agg(F.count(F.lit(1)).alias("n_members"))
        return members.join(self.addresses.groupBy("domain").agg(F.count(F.lit(1)).alias("n_addresses")), "domain")

    def counts(self) -> DataFrame:
        """(company_id, n) pairs of every company that has any."""
        sizes = self.addresses.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
        each = salted_join(self.members, sizes, "domain", "inner", F.col("company_id"), self._hot())
        per = each.groupBy("company_id").agg(F.sum("n").alias("n"))
        if self.known is not None:
            known = self.known.groupBy("company_id").agg(F.count(F.lit(1)).alias("_known"))
            per = per.join(known, "company_id", "left").select("company_id", (F.col("n") - F.coalesce("_known", F.lit(0))).alias("n"))
        return per.filter("n > 0")

    def totals(self) -> DataFrame:
        """One row: companies and addresses that are in any pair, and the number of pairs, as an exact decimal."""
        sizes = self.sizes()
        product = F.col("n_members").cast("decimal(19,0)") * F.col("n_addresses").cast("decimal(19,0)")
        whole = sizes.agg(F.coalesce(F.sum(product), F.lit(0)).cast("decimal(38,0)").alias("_pairs"))
        named = self.addresses.join(sizes.select("domain"), "domain", "left_semi")
        known = F.lit(0) if self.known is None else F.lit(self.known.count())
        counts = self.counts().agg(F.count(F.lit(1)).alias("n_companies"))
        distinct = named.select("email").distinct().agg(F.count(F.lit(1)).alias("n_addresses"))
        # One row each.
        joined = whole.join(F.broadcast(counts), F.lit(True)).join(F.broadcast(distinct), F.lit(True))
        return joined.select("n_companies", "n_addresses", (F.col("_pairs") - known).cast("decimal(38,0)").alias("n_pairs"))

    def expand(self, companies: DataFrame | None = None) -> DataFrame:
        """The pairs themselves, of all companies or of those named (company_id): as many rows as there are."""
        members = self.members if companies is None else self.members.join(companies.select("company_id").distinct(), "company_id", "left_semi")
        hot = sorted({*self._hot(), *hot_keys(self.addresses, "domain")})
        rows = grid_join(members, self.addresses, "domain", F.col("company_id"), F.col("email"), hot).select(*PAIR, "domain")
        return rows if self.known is None else rows.join(self.known, PAIR, "left_anti")

    def save(self, path: str) -> None:
        """Three tables below ``path``."""
        self.members.write.parquet(f"{path}/members")
        self.addresses.write.parquet(f"{path}/addresses")
        known = self.members.limit(0).select("company_id", F.lit("").alias("email")) if self.known is None else self.known
        known.write.parquet(f"{path}/known")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SharedRows:
        return SharedRows(*[spark.read.parquet(f"{path}/{part}") for part in ("members", "addresses", "known")])


# Taken addresses of a company that are carried as a list in its row.
LISTED = 64


@dataclass(frozen=True)
class SharedFound:
    """Found rows as ``members`` (company_id, domain, copies) times ``addresses`` (domain, email).

    Every company stands once with its only domain, and how many rows it has
    itself; every address stands once per domain, in the form it is stored in.
    ``layout`` makes found rows of (company_id, domain, email). Rows are made
    where they are read, by a join that sorts members and addresses alone.
    """

    members: DataFrame
    addresses: DataFrame
    method: str
    method_ord: int
    layout: Callable[[DataFrame], DataFrame]

    def _pairs(self, members: DataFrame) -> DataFrame:
        hot = sorted({*hot_keys(self.members, "domain"), *hot_keys(self.addresses, "domain")})
        return grid_join(members, self.addresses, "domain", F.col("company_id"), F.col("email"), hot)

    def found(self) -> DataFrame:
        """All rows, as often as they were found."""
        return self.layout(self._pairs(self.members.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))))

    def inside(self, keys: DataFrame) -> DataFrame:
        """The distinct (company_id, email) among ``keys`` that are in the product, with domain and copies; written once."""
        own = keys.select(*PAIR).join(self.members, "company_id")
        return written(own.join(self.addresses, ["domain", "email"], "left_semi").distinct(), "shared-inside")

    def rows(self, inside: DataFrame) -> DataFrame:
        """Found rows of what ``inside`` gave."""
        return self.layout(inside)

    def rows_without(self, taken: DataFrame) -> DataFrame:
        """Each row once, but for the (company_id, email) of ``taken``, which come from ``inside``.

        A company carries its taken addresses, so the product is not sorted to
        leave them out; only companies with more than LISTED of them meet them in a join.
        """
        sizes = written(taken.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")), "shared-taken")
        many = sizes.filter(F.col("n") > LISTED).select("company_id")
        few = taken.join(sizes.filter(F.col("n") <= LISTED).select("company_id"), "company_id", "left_semi")
        lists = few.groupBy("company_id").agg(F.collect_list("email").alias("_taken"))
        light = self.members.join(many, "company_id", "left_anti").join(lists, "company_id", "left")
        free = F.col("_taken").isNull() | ~F.array_contains("_taken", F.col("email"))
        rows = self.layout(self._pairs(light).filter(free))
        heavy = self._pairs(self.members.join(many, "company_id", "left_semi")).join(taken.select(*PAIR), PAIR, "left_anti")
        return rows.unionByName(self.layout(heavy))

    def counts(self) -> DataFrame:
        """(company_id, method, n) of the companies with rows."""
        sizes = self.addresses.groupBy("domain").agg(F.count(F.lit(1)).alias("_size"))
        each = salted_join(self.members, sizes, "domain", "inner", F.col("company_id"), hot_keys(self.members, "domain"))
        return each.select("company_id", F.lit(self.method).alias("method"), (F.col("copies") * F.col("_size")).alias("n"))
