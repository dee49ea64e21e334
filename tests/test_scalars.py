"""Golden values of every column function."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contactloom.functions import domains as D
from contactloom.functions import emails as E
from contactloom.functions import text as X
from contactloom.functions.chars import EMAIL_TOKEN_FOLDED
from contactloom.operators import checks, listing
from contactloom.sources import results


def values(spark, inputs, *columns):
    """Results of the columns over inputs, in input order."""
    df = spark.createDataFrame(list(enumerate(inputs)), "n int, v string")
    rows = df.select("n", *[c.alias(f"c{i}") for i, c in enumerate(columns)]).orderBy("n").collect()
    found = [tuple(r)[1:] for r in rows]
    return [f[0] for f in found] if len(columns) == 1 else found



def V():
    return F.col("v")


SMILE = "\U0001f600"

CLEANERS = {
    X.clean_text: {
        "Normal Company Name": "Normal Company Name",
        f"Company {SMILE} with emoji": "Company with emoji",
        "Text   with    multiple   spaces": "Text with multiple spaces",
        "Company™ with trademark": "Company with trademark",
        "Café & Restaurant": "Café & Restaurant",
        f"{SMILE} Office Building {SMILE}": "Office Building",
        "   Leading and trailing spaces   ": "Leading and trailing spaces",
        "": "N/A",
        None: "N/A",
        "Company\nwith\nnewlines": "Companywithnewlines",
        "Special•Characters★Here": "SpecialCharactersHere",
        "A  B  ": "A B",
    },
    X.clean_phone: {
        "+61 123 456 789": "+61 123 456 789",
        f"{SMILE} +61-123-456-789": "+61-123-456-789",
        "(02) 1234-5678": "(02) 1234-5678",
        f"Phone: +61 123 456 789 {SMILE}": "+61 123 456 789",
        "123.456.7890": "1234567890",
        f"+61 {SMILE} 123 456 789": "+61 123 456 789",
        "": "N/A",
        None: "N/A",
    },
    X.clean_email: {
        "user@example.com": "user@example.com",
        f"{SMILE} contact@company.com": "contact@company.com",
        f"email: info@test.org {SMILE}": "emailinfo@test.org",
        "user+tag@domain.co.uk": "usertag@domain.co.uk",
        "invalid-email": "N/A",
        "": "N/A",
        None: "N/A",
        f"user@{SMILE}domain.com": "user@domain.com",
    },
    X.clean_website: {
        "https://www.example.com": "https://www.example.com",
        "company.com": "company.com",
        "www.test.org/path?param=value": "www.test.org/path?param=value",
        f"{SMILE} https://company.com": "https://company.com",
        f"http://{SMILE}emoji.com": "http://emoji.com",
        "https://x.com/a#b~c": "https://x.com/abc",
        "": "N/A",
        None: "N/A",
    },
    X.safe_name: {
        'a<b>:c"d/e\\f|g?h*': "a_b__c_d_e_f_g_h_",
        " .x. ": "x",
        " . ": "unnamed",
        "": "unnamed",
        None: "unnamed",
    },
    X.strip_ansi: {"\x1b[1;32mok\x1b[0m\r\n": "ok", "\x1bMplain": "plain", "\x1b[31m": ""},
    X.strip: {"\t  a b　\x85\n": "a b", " \x1c": "", None: None},
}


@pytest.mark.parametrize("fn", CLEANERS, ids=lambda f: f.__name__)
def test_cleaners(spark, fn):
    cases = CLEANERS[fn]
    assert values(spark, list(cases), fn(V())) == list(cases.values())


# input: record, static, static valid, strict, normalised, normalised valid, naive
DOMAINS = {
    "example.com": ("example.com", "example.com", True, "example.com", "example.com", True, "example.com"),
    "https://www.example.com/path?q=1#f": (
        "example.com", "example.com", True, "example.com", "example.com", True, "www.example.com",
    ),
    "http://Example.COM:8080/x": (
        "example.com:8080", "example.com:8080", False, None, "example.com", True, "Example.COM:8080",
    ),
    "HTTP://EXAMPLE.COM": ("http:", "http:", False, None, "http", False, "HTTP:"),
    "WWW.Example.com": (
        "example.com", "www.example.com", True, "www.example.com", "www.example.com", True, "WWW.Example.com",
    ),
    "  example.com ": (
        "  example.com ", "example.com", True, "example.com", "example.com", True, "  example.com ",
    ),
    "ftp://files.example.com/a": ("ftp:", "ftp:", False, None, "files.example.com", True, "ftp:"),
    "httpbin.org": ("", "httpbin.org", True, "httpbin.org", "httpbin.org", True, "httpbin.org"),
    "user:pw@host.com": ("user:pw@host.com", "user:pw@host.com", False, None, "user", False, "user:pw@host.com"),
    "localhost": ("localhost", "localhost", False, None, "localhost", False, "localhost"),
    "a..b.com": ("a..b.com", "a..b.com", False, None, "a..b.com", False, "a..b.com"),
    "-bad.com": ("-bad.com", "-bad.com", False, None, "-bad.com", False, "-bad.com"),
    "example.com?x=1": (
        "example.com", "example.com", True, "example.com", "example.com", True, "example.com?x=1",
    ),
    "N/A": ("n", "n", False, None, "n", False, "N"),
    "x.y": ("x.y", "x.y", True, "x.y", "x.y", False, "x.y"),
    "": (None, "", False, None, None, False, ""),
    None: (None, "", False, None, None, False, None),
    "http://exa\tmple.com": ("example.com", "example.com", True, "example.com", "example.com", True, "exa\tmple.com"),
}


def test_domains(spark):
    columns = [
        D.domain_record(V()),
        D.domain_static(V()),
        D.is_valid_domain(D.domain_static(V())),
        D.domain_strict(V()),
        D.domain_normalized(V()),
        D.is_valid_domain_strict(V()),
        D.domain_naive(V()),
    ]
    got = dict(zip(DOMAINS, values(spark, list(DOMAINS), *columns)))
    assert got == DOMAINS


VALIDITY = {
    "test@example.com": (True, True, True),
    "invalid-email": (False, False, False),
    "test@.com": (False, False, False),
    "test@example": (False, False, False),
    "a@b.com!!": (True, False, False),
    ".a@b.com": (True, True, False),
    "a..b@c.com": (True, True, False),
    "a@b..com": (True, True, False),
    "a@-b.com": (True, True, False),
    "a@b-.com": (True, True, False),
    "x" * 65 + "@b.com": (True, True, False),
    "x" * 64 + "@b.com": (True, True, True),
    "a@" + "b" * 63 + ".com": (True, True, True),
    "a@" + "b" * 64 + ".com": (True, True, False),
    "a@www.com": (True, True, False),
    "a@www.b.com": (True, True, True),
    " A@B.Com ": (False, True, True),
    "a@b.com\n": (True, True, True),
    None: (False, False, False),
}


def test_email_validity(spark):
    columns = (E.is_email_prefix(V()), E.is_email_basic(V()), E.is_email_strict(V()))
    assert dict(zip(VALIDITY, values(spark, list(VALIDITY), *columns))) == VALIDITY


def test_email_domain(spark):
    assert values(spark, ["A@B.Com", "nope", None], E.email_domain(V())) == ["b.com", None, None]


def test_extract_emails(spark):
    texts = {
        "x foo@bar.com, FOO@bar.com. %a@b.org": ["foo@bar.com", "a@b.org"],
        "éinfo@x.com": [],
        "mail me at a.b+c@d-e.co.uk!": ["a.b+c@d-e.co.uk"],
        "a..b@c.com .z@c.com": ["z@c.com"],
        "Kim@x.com": ["kim@x.com"],
        "none here": [],
        None: [],
        "": [],
        "a." * 5000 + " end@of.text": ["end@of.text"],
    }
    assert values(spark, list(texts), E.extract_emails(V())) == list(texts.values())


def test_tokens_match_plain_pattern(spark):
    """The linear pattern finds what the plain one finds, on random junk."""
    draw = random.Random(5)
    alphabet = "ab1é_.%+-@@.-  \n"
    texts = ["".join(draw.choices(alphabet, k=draw.randint(3, 40))) + ".com" for _ in range(4000)]
    texts += [t.replace(" ", "@ab.ab") for t in texts]
    plain = re.compile(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b")
    want = [[e.lower() for e in plain.findall(t)] for t in texts]
    assert sum(map(len, want)) > 1000
    assert values(spark, texts, E.basic_tokens(V())) == want
    folded = [plain.findall(t) and re.findall(plain.pattern, t, re.IGNORECASE) for t in texts]
    got = values(spark, texts, F.regexp_extract_all(V(), F.lit(EMAIL_TOKEN_FOLDED), F.lit(1)))
    assert [g if w else [] for g, w in zip(got, folded)] == folded


def test_tokens_are_linear(spark):
    text = "a." * 500_000 + "-+" * 100_000 + " end@of.text"
    assert values(spark, [text], E.extract_emails(V())) == [["end@of.text"]]


def test_email_lists(spark):
    lists = F.split(V(), ",")
    assert values(spark, ["b@x.io,a@x.io", "q\"x"], E.emails_to_json(lists)) == ['["a@x.io", "b@x.io"]', '["q\\"x"]']
    back = values(
        spark, ['["a@b.com", "x", 1, "a@b.com"]', "", None, '{"a": 1}', "[bad", '"a@b.com"'], E.emails_from_json(V())
    )
    assert back == [["a@b.com"], [], [], [], [], []]
    shown = values(spark, ["b,a", "c,b,a", None], X.display_list(lists, 2))
    assert shown == ["a, b", "a, b ... and 1 more", "No emails"]
    assert values(spark, [" INFO@x.com, bad, ,ceo@x.com,ceo@x.com", " ", None], E.split_existing(V())) == [
        ["info@x.com", "ceo@x.com", "ceo@x.com"], [], [],
    ]


RESULTS = {
    '{"emails": ["Info@x.com", "bad"], "people": [{"email": "p1@y.org"}, {"name": "n"}, 7], "email": "a..b@c.com"}': {
        "info@x.com", "p1@y.org", "a..b@c.com",
    },
    '{"email": "-q@b.com"}': {"-q@b.com", "q@b.com"},
    '{"emails": [" -q@b.com "], "note": "+z@b.com"}': {"-q@b.com", "q@b.com", "z@b.com"},
    '{"note": "hi\\ninfo@x.com \\u00e9z@y.com"}': {"info@x.com"},
    '{"a": [1, {"deep": ["x", {"key@in.key": "d@e.org"}]}]}': {"key@in.key", "d@e.org"},
    '{"note": "say \\"x@y.com\\" \\\\ok@y.com"}': {"x@y.com", "ok@y.com"},
    '{"emails": ["esc\\u0040aped.com"]}': {"esc@aped.com"},
    '["l@m.no"]': {"l@m.no"},
    "not json a@b.com": set(),
    '{"broken": "a@b.com"': set(),
    "": set(),
    None: set(),
}


def test_result_documents(spark):
    df = spark.createDataFrame(list(enumerate(RESULTS)), "n int, body string")
    got = {body: set() for body in RESULTS}
    bodies = list(RESULTS)
    for row in results.emails_from_results(df, ["n"]).collect():
        got[bodies[row["n"]]].add(row["email"])
    assert got == RESULTS


def test_long_strings_do_not_overflow(spark):
    body = '{"note": "' + "x\\n" * 200_000 + 'a@b.com"}'
    df = spark.createDataFrame([(1, body)], "n int, body string")
    assert [r["email"] for r in results.emails_from_results(df, ["n"]).collect()] == ["a@b.com"]


def test_lines(spark):
    df = spark.createDataFrame([(" A@b.com \t",), ("a@b.com",), ("two a@b.com",), ("",)], "line string")
    assert [r["email"] for r in results.emails_from_lines(df).collect()] == ["a@b.com"]


def test_guess(spark):
    inputs = ["example.com", "sub.example.com", "", None, "-a.b", "WWW.X.com"]
    assert values(spark, inputs, listing.guess_email(V())) == [
        "info@example.com", "info@sub.example.com", "N/A", "N/A", "info@-a.b", "info@www.x.com",
    ]


FULL = (
    '{"is_reachable": "safe", "mx": {"accepts_mail": true, "records": ["a.", "b."]}, "misc": {"is_disposable": false}, '
    '"smtp": {"is_deliverable": true}}'
)


def test_replies(spark):
    replies = [
        FULL, '{"error": "timeout"}', '{"error": null}', "", None, "{}", "{bad", '{"mx": {}}',
        '{"mx": {"records": null}}', '{"mx": null, "is_reachable": "risky"}',
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "n int, reply string")
    rows = checks.flatten_replies(df).orderBy("n").collect()
    assert [r["is_error"] for r in rows] == [False, True, True, True, True, True, True, False, False, False]
    assert [r["check_error"] for r in rows] == [
        None, "timeout", None, "no_response", "no_response", "no_response", "json_decode_error", None, None, None,
    ]
    assert [r["records"] for r in rows] == ['["a.", "b."]', *[None] * 6, "[]", "null", "[]"]
    first = rows[0]
    assert (first["is_reachable"], first["mx_accepts_mail"], first["is_disposable"], first["is_deliverable"]) == (
        "safe", True, False, True,
    )
    assert first["is_role_account"] is None and rows[9]["is_reachable"] == "risky"


def test_failure_codes(spark):
    cases = [
        ("ok", None, None, None),
        ("timeout", None, None, "timeout"),
        ("http_error", 503, None, "http_error_503"),
        ("connection_error", None, None, "connection_error"),
        ("json_decode_error", None, None, "json_decode_error"),
        ("crash", None, "KeyError", "exception_KeyError"),
    ]
    df = spark.createDataFrame(cases, "o string, s int, d string, want string")
    got = df.select("want", checks.failure_code(F.col("o"), F.col("s"), F.col("d")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
