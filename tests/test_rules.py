"""Rule operators on the reference's own small cases (classification, gate, veto)."""

from pyspark.sql import functions as F

from rankline.operators import rules


def _df(spark, rows):
    return spark.createDataFrame(rows, "title string, description_raw string")


def test_classification_cases(spark):
    inc = ["Python", "Django", "Remote"]
    exc = ["Presencial", "Java", "PHP"]
    rows = [
        ("Backend Python", "Vaga remota"),            # include hit
        ("Dev JavaScript", "Frontend"),               # 'java' is a substring of javascript
        ("Dev", "Trabalho presencial em SP"),         # exclude, case-insensitive
        ("Analista", "Nada relevante"),               # pending
        ("Python Dev", "PHP e Java"),                 # exclusion wins, first in list order
    ]
    out = rules.classify_columns(_df(spark, rows), inc, exc).collect()
    got = [(r.rule_status, r.rule_reason) for r in out]
    assert got == [
        ("ready_for_ai", None),
        ("discarded", "Palavra excluida: Java"),
        ("discarded", "Palavra excluida: Presencial"),
        ("pending", None),
        ("discarded", "Palavra excluida: Java"),
    ]


def test_casefold_sharp_s(spark):
    out = rules.classify_columns(_df(spark, [("Straße", "")]), ["STRASSE"], []).collect()
    assert out[0].rule_status == "ready_for_ai"


def test_gate_counts_and_threshold(spark):
    inc = ["python", "fastapi", "django"]
    rows = [("Vendedor", "Vendas externas"), ("Backend Engineer Python", "FastAPI e Django")]
    out = rules.gate_columns(_df(spark, rows), inc, threshold=3).collect()
    assert [(r.match_count, r.passes) for r in out] == [(0, False), (3, True)]


def test_gate_whole_words(spark):
    rows = [("go developer", ""), ("django developer", ""), ("c# dev", ""), ("c#/net", "")]
    out = rules.gate_columns(_df(spark, rows), ["go", "c#"], threshold=1).collect()
    # "go" does not match inside "django"; a keyword ending in '#' needs a word char after it
    assert [r.match_count for r in out] == [1, 0, 0, 0]


def test_gate_empty_list_passes(spark):
    out = rules.gate_columns(_df(spark, [("x", "y")]), [], threshold=3).collect()
    assert (out[0].match_count, out[0].passes) == (0, True)


def test_gate_case_sensitive_dedupe_counts_twice(spark):
    out = rules.gate_columns(_df(spark, [("python", "")]), ["Python", "python"], threshold=2).collect()
    assert out[0].match_count == 2
    out = rules.gate_columns(_df(spark, [("python", "")]), ["Python", "python"], threshold=2,
                             dedupe_casefold=True).collect()
    assert out[0].match_count == 1


def test_title_veto(spark):
    df = spark.createDataFrame(
        [("Sales Engineer",), ("Salesforce Developer",), ("Designer de Produto / Marketing",),
         ("Backend Dev",)], "title string")
    out = rules.title_veto_columns(df).collect()
    assert [list(r.veto_hits) for r in out] == [["sales"], [], ["designer", "marketing"], []]
    assert out[2].veto_summary.endswith("'designer', 'marketing'.")


def test_reclassify_keeps_analyzed(spark):
    df = spark.createDataFrame(
        [("Python", "", "analyzed", None), ("Python", "", "pending", None), ("x", "", "pending", None)],
        "title string, description_raw string, status string, filter_reason string",
    ).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    out = rules.reclassify(df, ["Python"], [], F.lit("2025-01-01").cast("timestamp_ntz")).collect()
    assert [r.status for r in out] == ["analyzed", "ready_for_ai", "pending"]
    assert out[0].updated_at is None and out[1].updated_at is not None and out[2].updated_at is None


def test_keyword_hits_literal_and_join_paths_agree_on_words(spark):
    df = spark.createDataFrame(
        [(1, "Python dev", "django, java e javascript"), (2, "Vendas", "home office")],
        "seq long, title string, description_raw string")
    kw = spark.createDataFrame(
        [("include", 0, "Python"), ("include", 1, "Home Office"), ("exclude", 0, "Java")],
        "list_name string, pos int, keyword string")
    lit = {(r.seq, r.keyword): (r.substring_hit, r.word_hit) for r in rules.keyword_hits(df, kw).collect()}
    assert lit == {(1, "Python"): (True, True), (1, "Java"): (True, True), (2, "Home Office"): (True, True)}
    joined = {(r.seq, r.keyword) for r in rules.keyword_hits(df, kw, max_literal_keywords=0).collect()}
    assert joined == {k for k, (s, w) in lit.items() if w}


import pytest  # noqa: E402


@pytest.mark.parametrize("title,desc,inc,exc,status,reason", [
    ("Desenvolvedor Python", "Vaga 100% presencial", ["Python"], ["Presencial"], "discarded",
     "Palavra excluida: Presencial"),
    ("Engenheiro Backend", "Atuacao com Python e APIs", ["Python"], ["Presencial"], "ready_for_ai", None),
    ("Software Engineer", "Stack diversa sem termos de filtro", ["Django"], ["PHP"], "pending", None),
    ("Dev Python", "Projeto com migracao de Java para Python", ["Python"], ["Java"], "discarded",
     "Palavra excluida: Java"),
    ("Desenvolvedor", "Modelo HÍBRIDO com alguns dias em Home office", ["Home Office"], ["Híbrido"],
     "discarded", "Palavra excluida: Híbrido"),
])
def test_reference_classification_cases(spark, title, desc, inc, exc, status, reason):
    r = rules.classify_columns(_df(spark, [(title, desc)]), inc, exc).collect()[0]
    assert (r.rule_status, r.rule_reason) == (status, reason)


@pytest.mark.parametrize("kws,text,threshold,passes,count", [
    (["python", "fastapi", "django", "postgresql"], "Backend Engineer com Python, FastAPI e Django", 3, True, 3),
    (["python", "fastapi", "django"], "Backend Engineer com Python apenas", 3, False, 1),
    (["python", "fastapi"], "Engenheiro com PYTHON e FASTAPI", 2, True, 2),
    ([], "Qualquer conteudo", 3, True, 0),
])
def test_reference_gate_cases(spark, kws, text, threshold, passes, count):
    r = rules.gate_columns(_df(spark, [(text, "")]), kws, threshold=threshold).collect()[0]
    assert (r.passes, r.match_count) == (passes, count)


@pytest.mark.parametrize("title,vetoed,hit", [
    ("Contador Senior", True, "contador"),
    ("Product Designer", True, "designer"),
    ("Data Scientist", True, "data scientist"),
    ("Data Science Engineer", True, "data science"),
    ("Growth Hacker", True, "growth hacker"),
    ("Backend Developer", False, None),
    ("Backend Engineer", False, None),
    ("Fullstack Software Engineer Core", False, None),
    ("Senior Full Stack Software Engineer", False, None),
])
def test_reference_veto_cases(spark, title, vetoed, hit):
    r = rules.title_veto_columns(spark.createDataFrame([(title,)], "title string")).collect()[0]
    assert r.vetoed is vetoed
    if hit:
        assert f"'{hit}'" in r.veto_summary and "fora de desenvolvimento" in r.veto_summary
