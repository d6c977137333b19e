import pytest

from townkit.sources import listing_rows


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        ("<table><tr><th>Day</th><th> What </th></tr><tr><td>Mon<td><a href='/x'>Story <b>time</b></a></td></tr><tr><td>alone</td><td> </td></tr></table><article>An article of 1 May 2024 here</article>", [("tr", "Day | What"), ("tr", "Mon Story time | Story time | LINKS: Story time [https://a.org/x]")]),
        ("<article>too short</article><li>Saturday 4 May at the hall</li><li>Menu item without a day at all</li><li><a href='b'>A link to a page</a></li>", [("li", "Saturday 4 May at the hall")]),
        ("<div class='big event'>Fun on 2024 in the &amp; park<script>var d = '2025'</script></div><li>Saturday 4 May at the hall</li>", [(".event", "Fun on 2024 in the & park")]),
        ("<li><a href='b'>A link to another page</a></li><li><a href='b'>A link to another page</a></li><li><a href='mailto:x@y'>Write to us at any time</a></li>", [("li", "A link to another page | LINKS: A link to another page [https://a.org/b]")]),
        ("<article>" + "x" * 1201 + " 2024</article>", []), ("", []), ("<li>broken <b>On 12/05 at noon in town", [("li", "broken On 12/05 at noon in town")]), ("</div></li>" * 3, []),
    ],
)
def test_lines(html, lines):
    assert listing_rows.listing_lines(html, "https://a.org/") == lines


def test_limit_and_depth():
    many = "".join(f"<li>Walk number {i} on 4 May 2024</li>" for i in range(400))
    assert len(listing_rows.listing_lines(many, "")) == 150
    assert listing_rows.listing_lines("<div>" * 50_000 + "<li>Saturday 4 May at the hall", "") == [("li", "Saturday 4 May at the hall")]


def test_pages(spark):
    rows = [(1, "https://a.org/", "<li>Saturday 4 May at the hall</li>", "x"), (2, None, "<li><a href='/x'>A page of some length</a></li>", "y"), (3, None, None, "z"), (None, "u", "<li>Saturday 4 May at the hall</li>", "x")]
    found = listing_rows.read_lines(spark.createDataFrame(rows, "page_id int, url string, html string, line string"))
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, 0, "li", "Saturday 4 May at the hall"), (None, 0, "li", "Saturday 4 May at the hall")]
