import json

from townkit.sources import frames


def page(*frames_, cut=None):
    """A page that pushes frames (id, text or value), in two pushes."""
    data = b""
    for name, value in frames_:
        if isinstance(value, str):
            data += f"{name}:T{len(value.encode()):x},".encode() + value.encode()
        else:
            data += f"{name}:{json.dumps(value, ensure_ascii=False)}\n".encode()
    text = data.decode()[:cut]
    half = len(text) // 2
    return "<html><script>var x = 1</script>" + "".join(f"<script>self.__next_f.push({json.dumps([1, t])})</script>" for t in (text[:half], text[half:])) + "<script>self.__next_f.push([0])</script></html>"


def index(*records):
    return ["$", "div", None, {"children": [{"isEvents": True, "source": list(records)}]}]


def test_records_with_references(spark):
    whole = page(("a", "Déjà vu: 1f:T3,xyz\n{not a frame}"), ("b", "$a"), ("c", "$b"), ("d", "$e"), ("e", "$d"), ("f", "$99"), ("5", {"x": 1}), ("1f", index({"title": "A", "description": "$a"}, {"title": "B", "description": "$c", "requirements": "$zz"}, {"title": "C", "description": "$d", "description_html": "$7"}, {"title": "D", "description": "$f", "requirements": "cost $5"})))
    rows = [
        (1, whole), (2, page(("a", "text"), ("b", {"isEvents": True, "source": []}))), (3, page(("a", index({"t": 1})), ("b", index({"t": 2})))), (4, page(("a", "a long text"), cut=8)), (5, page(("a", index({"t": 1})), cut=30)),
        (6, "<html><p>nothing</p></html>"), (7, None), (8, "<script>self.__next_f.push([1,</script>"), (9, page(("0", "x"), ("1", index({"description": "$0", "requirements": None})))),
    ]
    found, problems = frames.published_records(spark.createDataFrame(rows, "page_id int, html string").repartition(3))
    text = "Déjà vu: 1f:T3,xyz\n{not a frame}"
    assert {(r["page"], r["place"]): (r["description"], r["description_html"], r["requirements"]) for r in found.collect()} == {
        (1, 0): (text, None, None), (1, 1): (text, None, "$zz"), (1, 2): (None, "$7", None), (1, 3): ("$99", None, "cost $5"), (9, 0): ("x", None, None)
    }
    assert {r["page"]: r["problem"] for r in problems.collect()} == {2: "missing index", 3: "ambiguous index", 4: "incomplete text frame", 5: "malformed frame", 8: "malformed data"}


def test_chains_and_circles(spark):
    chain = [(1, str(i), f"${i + 1}") for i in range(9)] + [(1, "9", "end")]
    circle = [(2, str(i), f"${(i + 1) % 6}") for i in range(6)] + [(2, "9", "$3"), (2, "a", "$a"), (3, "1", "$2")]
    found = {(r["page"], r["id"]): r["value"] for r in frames.resolved_texts(spark.createDataFrame(chain + circle, "page int, id string, value string")).collect()}
    assert all(found[1, str(i)] == "end" for i in range(10)) and all(v is None for (p, _), v in found.items() if p == 2) and found[3, "1"] == "$2" and len(found) == len(chain) + len(circle)
    assert frames.resolved_texts(spark.createDataFrame([], "page int, id string, value string")).count() == 0
