import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat_format as m
from lakeloom.llm import chat_template as t

from .helpers import SF, spark_rows, sql_rows


def render(source, turns=()):
    out = []
    t.compile_template(source)(turns, lambda text, masked: out.append((text, masked)))
    return "".join(x for x, _ in out), "".join(x for x, on in out if on)


def test_language():
    turns = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "Yo"}]
    src = ("{# note #}{% set n = 'x' ~ (1 + 2) %}{% for m in turns -%}  {% if loop.first %}<{% elif not loop.last %}|{% else %}>{% endif %}"
           "{{ m['role']|upper }}{{ loop.index }}/{{ loop.index0 }}{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}{{ n }}{{ loop }}{{ m }}")
    assert render(src, turns) == ("<USER1/0hi>ASSISTANT2/1Yox3", "hiYo")
    assert render("{{ 1 + 2 }}{{ 'a' in 'cat' and not false }}{{ ('b' ~ none ~ 3)|length }}{{ 2 >= 3 or 'z' }}") == ("3True2z", "")
    assert render("a {{- 'b' -}} c") == ("abc", "")
    assert render("{% for m in turns %}{% for k in m %}{{ k }}{% endfor %}{{ m.role }}{% endfor %}", turns[:1]) == ("roletextuser", "")


def test_constants_fold():
    tree = t.fold_nodes(t.parse("a{{ 'b' ~ (1 + 1) }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false %}no{% endif %}d{{ x }}"))
    assert tree == [("text", "ab2cd"), ("out", ("name", "x"))]
    tree = t.fold_nodes(t.parse("{% if x %}a{% elif true %}b{% else %}c{% endif %}"))
    assert tree == [("if", [(("name", "x"), [("text", "a")]), (("value", True), [("text", "b")])])]


@pytest.mark.parametrize("source", ["{% for m turns %}{% endfor %}", "{% if x %}", "{{ x|eval }}", "{{ x( }}", "{% import os %}", "{{ 1 + 'a' }}",
                                    "{% endfor %}", "{{ x.}}", "{{ }}", "{% set 1 = 2 %}", "{{ x() }}"])
def test_wrong_templates_are_refused(source):
    with pytest.raises(t.TemplateError):
        t.compile_template(source)


def test_only_dictionary_keys_are_reachable():
    assert render("{{ turns.__class__ }}{{ turns['append'] }}{% for m in turns %}{{ m.text.upper }}{{ m.items }}{% endfor %}", [{"text": "x"}]) == ("", "")


def test_escapes_are_reversible():
    for text in ("", "\\", "\\\\### ", "### x </turn>\n", "\\### Assistant: </turn> ok", "a:b\nc\\", "###  ### \\</turn>"):
        assert t.unescape(t.escape(text)) == text and t.unescape(t.escape_role(text)) == text
        assert "</turn>" not in t.escape(text).replace("\\</turn>", "")


ROWS = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, None, "first"),
        (2, 5, "a:b\n### ", "x"), (2, 5, "a:b\n### ", "x"), (3, 0, "assistant", "</turn>\n### user:\nno\n</turn>\n\\"), (4, 0, "ASSISTANT", "é\u2028😀"),
        (5, 0, "assistant", "long \\" * 50000), (6, 1, "assistant", "\\"), (6, 2, "user", "\\### "), (6, 3, "assistant", "end:")]


def conversations(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("id", "conv", "loss_chars", "n_turns"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_awkward_rows_match_sql(spark):
    frame = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    given = conversations(spark)
    extra = spark.createDataFrame([(-7, i, r, m.EXTRA_TEXT) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    got = m.conversation_digests(given.select("conv_id", "turn", "role", "text").unionByName(extra))
    assert spark_rows(got) == sql_rows(m.SQL, conversations=frame)
    assert m.conversation_digests(given).count() == 6


def test_query_matches_sql(spark):
    assert spark_rows(m.op4_chat_format(spark, SF)) == sql_rows(m.SQL)


def test_null_conversation_and_empty_table(spark):
    rows = m.conversation_digests(conversations(spark, [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, 0, "user", "z")])).collect()
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in rows} == {(None, 2, 1), (1, 1, 0)}
    assert m.conversation_digests(conversations(spark).limit(0)).count() == 0


def test_formatted_text_and_spans(spark):
    rows = {r["conv_id"]: r for r in m.format_conversations(conversations(spark)).collect()}
    r = rows[6]
    assert r["formatted"] == "### assistant:\n\\\\</turn>\n### user:\n\\\\\\### </turn>\n### assistant:\nend:</turn>\n"
    assert [r["formatted"][a:b] for a, b in r["loss_spans"]] == ["\\\\", "end:"]
    assert rows[4]["loss_spans"] == [] and rows[3]["formatted"].count("</turn>\n") == 3
