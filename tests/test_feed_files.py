"""Large feeds read in ranges, against reading them whole."""

import random

import pytest
from pyspark.sql import functions as F

from salesmerge.sources.feed_files import scan_feed_files
from salesmerge.sources.feeds import scan_feed_xml
from salesmerge.sources.landed import read_landed

RSS = '<?xml version="1.0"?>\n<rss version="2.0"><channel><title>Deeds &amp; more</title>{}</channel></rss>\n'
ATOM = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>{}</feed>'


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "0"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def item(rng, k):
    parts = [f"<title>Sale {k} &gt; {k + 1}</title>", f"<link>https://d.example/{k}</link>",
             f"<description>Lot &lt;b&gt;{k}&lt;/b&gt; {'long ' * rng.choice([0, 3, 300])}</description>",
             rng.choice(["<pubDate>Fri, 06 Mar 2026 09:30:00 -0500</pubDate>", "<dc:date>2026-03-08</dc:date>", ""])]
    rng.shuffle(parts)
    return f"<item{rng.choice(['', ' id=\"7\"'])}>\n{''.join(parts)}</item>" + rng.choice(["", "\n  ", "<ttl>5</ttl>"])


def entry(rng, k):
    return (f"<entry><title>House {k}</title><summary>In Wayne {'x' * rng.choice([0, 900])}</summary>"
            f"<link href=\"https://a.example/{k}\"/><link href=\"u\"/><updated>2026-03-05T08:00:00Z</updated></entry>")


def both(spark, folder):
    """Rows of either way in order, without the numbers of the order."""
    whole, failed = read_landed(spark, folder)
    ways = (scan_feed_files(spark, f"{folder}/*/*"), scan_feed_xml(whole))
    out = []
    for rows, failures in ways:
        listed = rows.orderBy("source", "record_ord").collect()
        assert len({(r.source, r.record_ord) for r in listed}) == len(listed)
        out.append(([(r.source, r.title, r.summary, r.link, r.published) for r in listed],
                    sorted(map(tuple, failures.select("source", "page_no", "status", "message").collect()))))
    return out


def test_ranges_give_the_entries_of_the_whole(spark, tmp_path, small_ranges):
    rng = random.Random(4)
    pages = {
        "a/1.xml": RSS.format("".join(item(rng, k) for k in range(40))),
        "a/2.xml": ATOM.format("".join(entry(rng, 100 + k) for k in range(30))),
        "a/3.xml": RSS.format(""),
        "a/4.xml": RSS.format("<item/>" + item(rng, 900)).strip(),
        "b/1.xml": RSS.format("".join(item(rng, 200 + k) for k in range(9))).replace("</channel>", ""),
        "c/1.xml": RSS.format("".join(item(rng, 300 + k) for k in range(9)))[:-700],
        # Tags where they are no tags: read whole.
        "d/1.xml": RSS.format("<!-- <item> -->" + item(rng, 400) + "<item><title><![CDATA[a </item> b]]></title></item>" + item(rng, 401)),
        "e/1.xml": "no xml at all", "f/1.xml": RSS.format("<item><title>x</item>"),
    }
    for name, body in pages.items():
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text(body)
    ours, theirs = both(spark, str(tmp_path))
    assert ours == theirs
    assert len([r for r in ours[0] if r[0] == "a"]) == 72 and len([r for r in ours[0] if r[0] == "d"]) == 3


def test_a_page_may_have_more_entries_than_a_packed_order(spark, tmp_path):
    n = 70_000
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.xml").write_text(RSS.format("".join(f"<item><title>{k}</title></item>" for k in range(n))))
    rows, failures = scan_feed_files(spark, f"{tmp_path}/s/*")
    assert failures.count() == 0 and rows.select("record_ord").distinct().count() == n
    assert rows.orderBy(F.desc("record_ord")).first().title == str(n - 1)
