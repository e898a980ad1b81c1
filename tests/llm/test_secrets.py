import re
import time

import pytest

from astrolign.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [(s, secrets.KINDS[k], e) for s, k, e in sorted(out)]


TEXTS = [
    None, "", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "secret=token: abcdefgh PASSWORD:'longenough' passwd=short", "ſecret=abcdefgh toKen=abcdefgh", "AKIAAKIA" + "Q" * 14 + " AKIA123",
    "é𝒳 api_key: ab/cd+ef== apikey=x.y.z-12 " + "0123456789abcdef" * 3 + "G", "a=" * 20_000, "deadbeef" * 10_000, "password=" * 50,
]


def test_base_spans(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, TEXTS[2], "x")], "doc_id long, text string, spans string")
    rows = secrets.scan(frame).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[2 if r.doc_id is None else r.doc_id]
        assert [(x.start, x.kind, x.end) for x in r.spans if x.kind != "literal"] == brute(text)
    assert secrets.scan(frame.where("false")).collect() == []


def found(text):
    return [text[s:e] for s, e in secrets.literals(text)]


def test_lexer_scores_names_and_literals():
    assert found('db_password := "Tr0ub4dor&3x!"') == ["Tr0ub4dor&3x!"]
    assert found('{"client": {"authToken": "q8Zk2LmP0x"}}') == ["q8Zk2LmP0x"]
    assert found('K = "zX81kkPq02vB"\nother = 5\nsecret_key = K\n') == ["zX81kkPq02vB"]  # carried on
    assert found('export AUTH_TOKEN="aB3" + "dE5fG7"') == ['aB3" + "dE5fG7']
    assert found('title = "A long and quiet evening"\ncolour: blue42\nkeyboard = "us-intl105"') == []
    assert found("the token of the ring: he said at 10:45 == nothing") == []


def test_redaction():
    assert secrets.redacted('x token = "abcdefgh1234" y AKIA' + "Z" * 20) == 'x [SECRET]" y [SECRET]'
    assert secrets.redacted("clean text: nothing = here") == "clean text: nothing = here"


def test_redaction_keeps_columns_and_nulls(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "passwd: abcdefgh", "b")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, secrets.redact(frame).collect())) == [(1, None, "a"), (2, "[SECRET]", "b")]


S = "q8Zk2LmP0xW4rT7v"


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        (f'password: str = "{S}"', S), (f'cfg["api_key"] = "{S}"', S), (f"connect(user='me', password='{S}')", S), (f'db.password += "{S}"', S), (f"<password> {S} </password>", S), (f"login --token={S} --x=1", S),
        (f'auth_token = """{S}"""', S), (f"secret_key: |\n  {S}\nother: 5", S), (f"secret = <<END\n{S}\nEND\nx = 1", S), (f'SECRET = base64.b64decode("{S}")', S), (f'dsn = "Server=s1;Password={S};Pool=4"', S),
        (f"# old_password = '{S}'", S), (f"password = {S}  # rotate", S), (f'PART = "{S}"\npassword = PART + "x1"', S), (f'PART = "{S}"\npassword = f"pre-{{PART}}"', S), (f'PART = "{S}"\npassword = "%s-1" % PART', S), (f'PART = "{S}"\ntoken = "{{}}".format(PART)', S),
        (f'def f():\n    K = "{S}"\n    secret_key = K\n', S), (f'let K = `{S}`;\nif (x) {{\n  const authToken = K;\n}}', S), (f"'client_secret' => '{S}',", S), (f'api_key ?= "{S}"', S), (f'token = "q8Zk2LmP" "0xW4rT7v"', 'q8Zk2LmP" "0xW4rT7v'),
        (f"url = http://host/x?token={S}", S), (f'password = "q8\\"Zk2LmP0x"', 'q8\\"Zk2LmP0x'), (f"export A={S}; export API_KEY=$A", S), (f"A={S}\nAPI_KEY=${{A}}\n", S),
    ],
)
def test_syntaxes(text, literal):
    assert literal in found(text)


@pytest.mark.parametrize(
    "text",
    [
        'password = os.environ["DB_PASSWORD_NAME"]', 'password = os.getenv("PRODUCTION_Db_Passw0rd")', f"# K = '{S}'\nsecret_key = K", f'def f():\n    K = "{S}"\ndef g():\n    secret_key = K\n', f'{{ const K = "{S}"; }}\nsecretKey = K', "the password: it is written on the wall",
        "token == other_token_Value9", f'colour: "{S}"', 'password = "<your password here>"', f'/* K = "{S}" */\nsecret_key = K', "key: value\nmonkey = 'Bananas4everyone'", 'token: str = ""',
    ],
)
def test_what_is_no_secret(text):
    assert found(text) == []


HOSTILE = [
    "token=", "a=1&", 'token="', "token='\\'", "a = ", "secret: |\n", "token = <<A ", "token = <<A\n", "secret:", "{", "}{", "password   ", " " * 7 + ":", "token: a[", '"secret" : "x" + ', "x = x + 'a'\ntoken = x\n", "/*", "<a>", "<token>", "token = f(", 'token = f("', "token = " + "'" * 3, "a:b,",
    "token = t{}\n", "  " * 3 + "\n token = 'aB3dE5fG7'\n", "key = <<K{}\n", "AKIA", "0123456789abcdef", "é: ", "token \t", 'a="{}{{x}}"\n', "新=", '"a" ', "'a' + ", "`a` . ",
]


@pytest.mark.parametrize("unit", HOSTILE)
def test_a_megabyte_of_anything_takes_linear_time(unit):
    n = 1_000_000 // len(unit)
    text = "".join(unit.replace("{}", str(k)) for k in range(n)) if "{}" in unit else unit * n
    text = "secret key = x " + text
    start = time.process_time()
    secrets.spans(text)
    # The lexer sees about a million characters in a second or two; what is quadratic would take minutes.
    assert time.process_time() - start < 8


@pytest.mark.parametrize("unit", ['"a" ', "'aB3dE5fG7' + ", "x, "])
def test_one_value_of_a_megabyte_takes_linear_time(unit):
    """Strings side by side, joined strings, and a long list of names to format, as one sensitive value."""
    head = "x = 'aB3dE5fG7'\ntoken = '{}'.format(" if unit == "x, " else "token = "
    start = time.process_time()
    found = secrets.spans(head + unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 8
    assert ("literal" in {kind for _, kind, _ in found}) == (unit != '"a" ')


def test_spans_of_blanks_are_passed_once():
    text = "token" + " " * 300_000 + "= " + " " * 300_000 + "'" + " " * 300_000 + "x: " + " " * 100_000
    start = time.process_time()
    secrets.spans(text)
    assert time.process_time() - start < 2
