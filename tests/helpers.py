import json

from quarry.plans.search import Context, search
from quarry.sources.index import from_json


def index_of(spark, docs, name="i", **kw):
    rows = [(i, str(d["id"]), json.dumps(d)) for i, d in enumerate(docs)]
    return from_json(name, spark.createDataFrame(rows, "ord long, id string, body string"), **kw)


def run(index, request, context=None):
    indexes = index if isinstance(index, dict) else {index.name: index}
    return search(indexes, {"term": "", **request}, context or Context())


def ids(result):
    return [h["id"].split(":", 1)[1] for h in result["hits"]]


def compare(spark, query, sql, sf_dir):
    """Rows of a query and of its SQL as sorted texts."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    return rows(a), rows(b)
