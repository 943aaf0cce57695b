"""The lexer of secret scans: forms of assignments, what is none, scopes of constants, and time in proportion to length."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import secrets
from geoloom.llm.queries import op1_secrets

V = "Zx81$kqP02!m"


def literals(text):
    return [text[a:b] for a, _, b, *_ in secrets.scan_text(text)[1]]


FOUND = [
    f'pwd = "{V}"', f"pwd: '{V}'", f'"pwd": "{V}"', f"pwd := `{V}`", f'pwd => "{V}"', f"--pwd={V}", f"x=1&pwd={V}&y=2", f'pwd: str = "{V}"', f'const apiSecret: string = "{V}"', f'var dbPassword string = "{V}"',
    f'let pwd: &\'static str = "{V}";', f'pwd: Optional[str] = "{V}"', f'String pwd = "{V}";', f'std::string pwd = "{V}";', f'char pwd[] = "{V}";', f'conn["pwd"] = "{V}"', f'$this->pwd = "{V}";', f"<pwd>{V}</pwd>",
    f'<add key="dbPwd" value="{V}"/>', f'{{"name": "DB_PWD",\n "value": "{V}"}}', f'pwd = r"{V}"', f'pwd = """{V}"""', f"Authorization: Bearer {V}", f"don't tell: pwd: {V} isn't it", f'pwd{" " * 500}= "{V}"', f'db.{"x" * 900}.pwd = "{V}"',
    f'def f(a, pwd="{V}"):', f'f(pwd="{V}", x=1)', f'pwd = (\n"{V}")'.replace("\n", ""), f'pwd = \\\n  "{V}"', f'http://a.b/c // note\npwd = "{V}"',
]
NOT_FOUND = [
    f'# pwd = "{V}"', f'x = 1  // pwd = "{V}"', f'/* pwd = "{V}" */ x', f'<!-- pwd = "{V}" -->', f'print("pwd = {V}")', f"m = 'the pwd = \"{V}\" is'", f'pwd == "{V}"', f'pwd != "{V}"', f'pwd = get("{V}")', f'title = "{V}"',
    f'pwd_url = "{V}"', 'pwd = "changeme"', 'pwd = "${SECRET_VALUE}"', "pwd = None", "the key: a word", f"pwd\n= \"{V}\"",
]


@pytest.mark.parametrize("text", FOUND)
def test_forms_of_assignments(text):
    assert literals(text) == [V]


LONG = "y" * 300
LONG_NAMES = [f'{{"{LONG}_private_key": "{V}"}}', f"{{'name': '{LONG}_DB_PASSWORD', 'value': '{V}'}}", f'<add key="{LONG}dbPwd" value="{V}"/>', f'a={LONG}_password={V}', f'{LONG}_pwd = "{V}"', f'"{LONG * 300}_pwd": "{V}"']


@pytest.mark.parametrize("text", LONG_NAMES)
def test_names_of_any_length(text):
    assert literals(text) == [V]


def test_long_names_take_time_in_proportion():
    def took(n):
        text = f'"{"key_" * n}pwd": "{V}", ' + f'"{LONG}_pwd": "{V}", ' * (n // 80)
        start = time.perf_counter()
        assert len(literals(text)) == 1 + n // 80
        return time.perf_counter() - start

    took(8_000)
    assert took(160_000) < 40 * max(took(8_000), 0.01)


@pytest.mark.parametrize("text", NOT_FOUND)
def test_what_is_no_assignment_of_a_secret(text):
    assert literals(text) == []


def test_joined_and_escaped_literals():
    assert literals('pwd = "Zx81$kq" + "P02!mabc"') == ['Zx81$kq" + "P02!mabc']
    assert literals("pwd = 'Zx81$kq' \\\n 'P02!mabc'") == ["Zx81$kq' \\\n 'P02!mabc"]
    assert literals('pwd = "Zx81\\"$kqP02!m" # x') == ['Zx81\\"$kqP02!m']


def test_constants_follow_scopes():
    assert literals(f"K = '{V}'\nOTHER = K\nclient_credentials = OTHER") == [V]
    assert literals(f"def f():\n    K = '{V}'\n\npwd = K") == literals(f"function f() {{ const K = '{V}'; }}\npwd = K") == []
    assert literals(f"K = '{V}'\ndef f():\n    K = 'other'\n    x = 1\npwd = K") == literals(f"K = '{V}'; if (x) {{ pwd = K }}") == [V]
    assert literals(f"K = '{V}'\nclass A:\n    def f():\n        pwd = K") == literals(f"}}}} K = '{V}'\npwd = K") == [V]


NAMES = st.sampled_from(["pwd", "db_password", "apiKey", "title", "page", "K1", "K2"])
VALUES = st.text(alphabet="abXY019$!_", min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(['{n} = "{v}"', "{n}: '{v}'", "{n} := `{v}`", 'const {n}: string = "{v}";', "{n} = {r}", "// {n} = '{v}'", 'say("{n}={v}")', "<{n}>{v}</{n}>"]), NAMES, VALUES, st.sampled_from(["K1", "K2", "K3"])), max_size=12))
def test_pairs_equal_those_that_the_text_was_made_of(lines):
    """Every line is written from a known pair; literals, places and constants are worked out beside the lexer."""
    text, known, want = "", {}, {}
    for form, n, v, r in lines:
        at = len(text) + form.replace("{n}", n).find("{v}")
        text += form.format(n=n, v=v, r=r) + "\n"
        if "//" in form or "say" in form:
            continue
        place = known.get(r, (len(text) - 1 - len(r), len(text) - 1)) if "{r}" in form else (at, at + len(v))
        if "<" not in form or True:
            known[n] = place
        score = secrets.name_score(n) * secrets.literal_score(text[place[0] : place[1]])
        if secrets.name_score(n) >= 0.5 and score >= secrets.THRESHOLD:
            want[place] = max(score, want.get(place, 0))
    assert {(a, b): s for a, _, b, _, s in secrets.literal_spans(text)} == pytest.approx(want)


@pytest.mark.parametrize("unit", ["a=b&", "pwd=b&", "{a=b ", '"""\\', "/*a ", "'\\", "a:b[", "<a>b", '"a"+', "((((=", "pwd=K\n", "def a:\n ", "pwd" + " " * 40, "`", "a=b="])
def test_time_grows_with_length_alone(unit):
    took = []
    for n in (60_000, 480_000):
        start = time.perf_counter()
        secrets.scan_text("pwd " + unit * (n // len(unit)))
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0] + 0.5


def test_query_gives_the_scanner_s_spans(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op1_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base, more = secrets.scan_text(texts[r.doc_id])
        assert r.spans == secrets.joined(sorted([*base, *(m[:3] for m in more)]))
