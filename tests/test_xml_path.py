import json
import os
import random
import xml.etree.ElementTree as ET

import pytest

from lakeloom.sources import readers
from lakeloom.sources.xml_path import element_json, xml_rows

DOC = """<?xml version="1.0"?>
<!DOCTYPE r [ <!ELEMENT r (a|b)*> ]>
<r><!-- <a><row id="0"/></a> - > -->
<a><row id="1" note='x > y &amp; "z"'><name>A &lt; B</name><tag>p</tag><tag>q</tag></row><ns:row id="2"/></a>
<b><row id="3"><name>no</name></row></b>
<c><a><row id="4"><![CDATA[<row id="9">]]></row></a></c>
<a><other><row id="5"/></other><row>plain 7</row><row/></a>
</r>"""


def write(tmp_dir, text, name="d.xml"):
    with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as f:
        f.write(text)
    return tmp_dir


def found(spark, path, row_path):
    return sorted((json.loads(r["value"]) for r in xml_rows(spark, path, row_path).collect()), key=repr)


@pytest.mark.parametrize("size", ["128m", "23b", "90b"])
def test_paths_comments_and_quotes(spark, tmp_dir, size):
    path = write(tmp_dir, DOC)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        in_a = [{"@id": 1, "@note": 'x > y & "z"', "name": "A < B", "tag": ["p", "q"]}, {"@id": 2},
                {"@id": 4, "_text": '<row id="9">'}, {"_text": "plain 7"}, {"_text": None}]
        assert found(spark, path, "r/a/row") == sorted([in_a[0], in_a[1], in_a[3], in_a[4]], key=repr)
        assert found(spark, path, "a/row") == sorted(in_a, key=repr)
        assert found(spark, path, "r/b/x:row") == [{"@id": 3, "name": "no"}]
        assert len(found(spark, path, "row")) == 7
        assert len(found(spark, path, "")) == 1
        assert found(spark, path, "r/none") == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_file_in_many_blocks(spark, tmp_dir):
    r = random.Random(3)

    def element(depth):
        kids = "".join(element(depth + 1) for _ in range(r.randint(0, 3))) if depth < 5 else ""
        text = r.choice(["", "t", "<!-- c > d -->", "<![CDATA[ a > <row> ]]>", " & ".replace("&", "&amp;")])
        return f'<{(n := r.choice(["row", "a", "b"]))} k="{r.choice(["1", "x>y", ""])}">{text}{kids}</{n}>'

    doc = "<r>" + "".join(element(0) for _ in range(120)) + "</r>"
    path = write(tmp_dir, doc)

    def walk(e, above):
        names = [*above, e.tag]
        if names[-2:] == ["a", "row"]:
            yield element_json(ET.tostring(e, encoding="unicode"))
        for kid in e:
            yield from walk(kid, names)

    want = sorted(map(repr, map(json.loads, walk(ET.fromstring(doc), []))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = xml_rows(spark, path, "a/row")
        assert sorted(repr(json.loads(x["value"])) for x in rows.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_types_and_schema(spark, tmp_dir):
    write(tmp_dir, "<r><row><n>1</n><x>1.50</x><z>007</z></row></r>", "a.xml")
    path = write(tmp_dir, "<r><row><n>2</n><x>b</x><k><m>1</m></k></row></r>", "b.xml")
    df = readers.read_xml(spark, path, "r/row")
    assert dict(df.dtypes) == {"n": "bigint", "x": "string", "z": "string", "k": "struct<m:bigint>"}
    assert sorted(r["x"] for r in df.collect()) == ["1.50", "b"]
    assert sorted(r["n"] for r in readers.read_xml(spark, path, "row", "n string").collect()) == ["1", "2"]
