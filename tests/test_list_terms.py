"""JSON lists weighed by what a page was asked for, and by where their links lead."""

import json

from pyspark.sql import functions as F

from pagegrain.operators import structured


def _rows(kind, names, host="https://www.shop.test"):
    return [{"name": name, "price": 5 + at, "url": f"{host}/{kind}/{at}", "id": at, "sku": f"{kind}{at}", "stock": 1} for at, name in enumerate(names)]


def _best(spark, asked, use_terms):
    """asked: page -> (data, terms); the best list's name and score of every page that has one."""
    script = '<script type="application/json" id="__NEXT_DATA__">{}</script>'
    pages = spark.createDataFrame([(page, "https://shop.test/search?q=ring", script.format(json.dumps(data)), terms) for page, (data, terms) in asked.items()],
                                  "page_id long, url string, html string, terms array<string>")
    lists = structured.json_lists(structured.embedded_json(pages))
    best = structured.best_list(structured.score_lists(lists, pages, F.col("terms") if use_terms else None)).collect()
    return {row["page_id"]: (row["path"].split(".")[-1], round(row["score"], 4)) for row in best}


def test_terms_and_links_choose_the_list(spark):
    rings, others = _rows("p", ["Red ring", "Blue RING", "Old bolt"]), _rows("x", ["Gear", "Bolt", "Nut", "Spring"])
    data = {"props": {"found": rings, "popular": others}}
    away = {"props": {"found": rings, "popular": _rows("x", ["Gear", "Bolt", "Nut", "Spring"], "https://ads.other")}}
    # Without names the rows themselves are looked at.
    bare = {"props": {"found": [{"url": f"/p/ring-{at}", "price": at, "image": f"/i/{at}.jpg"} for at in range(3)]}}
    asked = {1: (data, ["ring"]), 2: (data, []), 3: (data, None), 4: (data, ["nothing"]), 5: (away, None), 6: (bare, ["ring"]), 7: (bare, ["bolt"]), 8: ({"props": {"found": rings}}, None)}
    plain, told = _best(spark, asked, False), _best(spark, asked, True)
    assert {page: plain[page][0] for page in plain} == {1: "popular", 2: "popular", 3: "popular", 4: "popular", 5: "found", 6: "found", 7: "found", 8: "found"}
    # Two of three names hold the term; the longer list never does.
    assert told == {1: ("found", round(plain[8][1] * (1 + 2 * 2 / 3), 4)), 2: plain[2], 3: plain[3], 5: plain[5], 6: ("found", round(plain[6][1] * 3, 4)), 8: plain[8]}
