"""The SQL of op4 on pages that the given table lacks: tags of every form."""

import random

import pandas as pd
import pytest

from quarry.llm import oracle_sql, url_filters

duckdb = pytest.importorskip("duckdb")


def pages():
    r = random.Random(6)
    hosts = ["a.example.net", "Example.net", "m.org", "x.m.org", "b.net", "example.com", "other.io", "third.io", "EX.com", ""]
    paths = ["", "/", "/en/", "/en/a", "/de/x", "/fr/p?q=1", "/d/e/f.html", "/d/../en/./k", "/..", "/a#top", "/a?u=http://k.io/#f"]
    targets = ["next.html", "?page=1", "./a", "../b", "../../../c/./d/..", "/x/../y?q=../z", "//b.net/p", "http://A.net/k#f", "sub/", "..", "#top", "mailto:x@y.z", "",
               "http://m.org/fr/p?a=1&amp;b=2", "//example.com/de/p", "/en/a"]
    tags = ['<link rel="canonical" href="{}">', "<LINK REL='alternate canonical' href={}>", "<link rel=canonical href='{}'>", '<link href="{}" rel="canonical nofollow"/>',
            '<link href="{}" rel=canonical>', '<meta http-equiv="refresh" content="0; URL={}">', "<meta http-equiv=refresh content='1;url={}'>",
            '<link rel="canonicals" href="{}">', '<base href="{}">']
    rows = [(1000, None, "<link rel=canonical href=q>"), (1001, "no scheme", None), (1002, "http://n.com/", ""), (1003, "", "<p>")]
    for i in range(300):
        html = "".join(r.choice(tags).format(r.choice(targets)) for _ in range(r.choice([0, 1, 1, 2, 3])))
        # in groups, so that some components hold a block and no allow
        html = html.replace("//b.net/p", f"//b.net/p{i // 4}").replace("m.org", f"m{i // 4}.org").replace("example.com/de/p", f"example.com/de/p{i // 4}")
        host = r.choice([f"s{i // 4}.io", f"T{i // 4}.io"]) if r.random() < 0.8 else r.choice(hosts)
        rows.append((i, f"{r.choice(['http', 'HTTPS'])}://{host}{r.choice(paths)}", html or None))
    return rows


def test_sql_follows_every_tag_and_target(spark):
    rows = pages()
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    con.execute("CREATE TABLE pages AS SELECT page_id::BIGINT AS page_id, url::VARCHAR AS url, html::VARCHAR AS html FROM given")
    want = sorted(con.execute(oracle_sql.OP4).fetchall())
    judged = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(tuple(r) for r in judged.select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want
    # verdicts by propagation occur
    assert sum(rule is None and verdict == "block" for _, _, _, rule, verdict in got) > 5
