"""package_set_whole on environments of more packages than package_set has names for."""

import hashlib
import time

from ledgerline.operators import maintenance
from ledgerline.plans import driver_queries


def test_digest_of_a_large_set_of_packages(spark, tmp_path):
    spark.createDataFrame([(k, k % 7, "b") for k in range(300)], "p_partkey long, p_size int, p_brand string").repartition(4).write.parquet(f"{tmp_path}/part.parquet")
    lines = sorted((f"p{k}", k % 7) for k in range(300))
    row = driver_queries.QUERIES["package_set_whole"](spark, str(tmp_path)).first()
    assert row.n_packages == 300
    assert row.digest == hashlib.sha256(("packages.v1\n" + "".join(f"pip {n} {v}\n" for n, v in lines)).encode()).hexdigest()


def test_names_that_stand_twice_are_found_in_large_sets_in_no_square_of_time(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("'even' as env", "'pip' as manager", "'p' || id as name", "'1' as version", "cast(null as string) as build", "'pip' as kind")
    odd = rows.selectExpr("'odd' as env", "manager", "if(name = 'p7', 'p8', name) as name", "if(name = 'p7', '2', version) as version", "build", "kind")
    began = time.time()
    got = {r.env: r for r in maintenance.package_set_digest(rows.unionAll(odd), "env", "packages.v1").collect()}
    assert time.time() - began < 60  # each name against each: over three thousand million comparisons
    assert (got["even"].n_packages, got["even"].collides, got["odd"].n_packages, got["odd"].collides, got["odd"].digest) == (n, False, n, True, None)
