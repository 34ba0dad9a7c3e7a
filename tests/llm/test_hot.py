from collections import Counter

from lapidary.llm.hot import MOST_HOT, SALTS, dealt, hot_keys, spread


def test_hot_keys_are_dealt_and_meet_their_fact_once(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, -1, id) as h", "id as node")
    counts = rows.groupBy("h").count().withColumnRenamed("count", "n")
    hot = hot_keys(counts, "h", 6000)
    assert [r.h for r in hot.collect()] == [-1] and hot_keys(counts, "h", 1500).count() == 4001
    salted = dealt(rows, hot, "h", "node")
    salts = Counter(r.salt for r in salted.where("h = -1").collect())
    assert len(salts) == SALTS and max(salts.values()) < 2000 / SALTS * 2 and salted.where("h <> -1 and salt <> 0").count() == 0
    joined = salted.join(spread(counts, hot, "h"), ["h", "salt"])
    assert sorted(map(tuple, joined.select("h", "node", "n").collect())) == sorted(map(tuple, rows.join(counts, "h").select("h", "node", "n").collect()))
    assert MOST_HOT == 2000 and dealt(rows.limit(0), hot, "h", "node").collect() == [] and spread(counts.limit(0), hot, "h").collect() == []
