import pytest
from pyspark.sql import functions as F

from loomlake.functions.template import TemplateError, compiled

ROWS = [(1, "d", [("a", [1, 2], True), ("b", [], None), (None, None, False)], 2.5), (2, None, [], 0.0), (3, "", None, None)]
SCHEMA = "id int, doc string, items array<struct<name:string,ns:array<int>,ok:boolean>>, x double"


def render(spark, template, **fixed):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return [r[0] for r in df.orderBy("id").select(compiled(template, df.schema, **fixed)).collect()]


@pytest.mark.parametrize("template,want", [
    ("plain\n", ["plain"] * 3),
    ("{{ id }}-{{doc}}|{{ x }}", ["1-d|2.5", "2-|0.0", "3-|"]),
    ("{% for i in items %}{{ loop.index }}/{{ loop.length }}{{ i.name }}{% if not loop.last %}, {% endif %}{% endfor %}", ["1/3a, 2/3b, 3/3", "", ""]),
    ("{% for i in items %}[{% for n in i.ns %}{{ n }}{% if loop.first %}*{% endif %}{% else %}-{% endfor %}]{% else %}none{% endfor %}", ["[1*2][-][-]", "none", "none"]),
    ("{% if doc == 'd' and x > 2 %}A{% elif x == 0 or doc %}B{% else %}C{% endif %}", ["A", "B", "C"]),
    ("{% for i in items %}{{ i.ok }}{% if i.ok != true %}!{% endif %};{% endfor %}", ["True;!;False!;", "", ""]),
    ("a  {%- if id -%}  b  {%- endif %} c {# no #}d", ["ab c d"] * 3),
    ("{{ doc | default('?') | upper }} {{ items | length }}", ["D 3", "? 0", " 0"]),
    ("{% for i in items %}{{ i.ns | join('+') }}{{ i.ns | tojson }}{% endfor %}{{ doc | tojson }}", ['1+2[1,2][]"d"', "null", '""']),
    ("{% for i in items %}{% for n in i.ns %}{{ i.name }}{{ n }}{{ id }}{% endfor %}{% endfor %}", ["a11a21", "", ""]),
    ("{{ kind }}{% if n < 3 and not (doc or x) %}!{% endif %}", ["k", "k!", "k!"]),
])
def test_templates(spark, template, want):
    assert render(spark, template, kind="k", n=2) == want


@pytest.mark.parametrize("bad", ["{{ no }}", "{% if id %}", "{% for x in doc %}{% endfor %}", "{% endfor %}", "{{ id | no }}", "{{ id id }}", "{{ doc.a }}", "{% for x y %}{% endfor %}", "{{ 'a }}"])
def test_faulty_templates(spark, bad):
    with pytest.raises(TemplateError):
        compiled(bad, spark.createDataFrame(ROWS, SCHEMA).schema)


def test_one_projection(spark):
    """No Python worker and no shuffle: the template is an expression."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = df.select(compiled("{% for i in items %}{{ i.name }}{% endfor %}", df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Eval" not in plan and F is not None
