"""Articles in several containers of one path."""

from sleuthframe.llm import htmlextract


def test_all_containers_at_the_winning_path(spark):
    one = "<body><div class='story'><p>{a}</p></div></body>"
    parts = "<body><div class='story'><p>{a}</p></div><div class='ad-box'>Buy</div><div class='story s'><p>x</p></div><div class='story'><p>{b}</p></div><div class='story'><a href='y'>More stories</a></div><footer>f</footer></body>"
    long, short = "words and more words " * 20, "the end of it"
    rows = [(i, "http://h.com", one.format(a=long)) for i in range(5)] + [(8, "http://h.com", parts.format(a=short, b=long)), (9, None, parts.format(a=long, b=short))]
    got = {r["page_id"]: r["text"] for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == long.strip() and got[8] == f"{short}\n{long.strip()}" and got[9] == f"{long.strip()}\n{short}"
