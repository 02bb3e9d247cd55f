"""Checks of captured HTTP responses. Nothing is sent: the capture is a table.

responses: target, probe, detail, seq, status_code, headers array<struct<name,value>>, body, elapsed_ms, tls_version,
tls_rank. probe says what was asked (root, cors, injection, markup, template, path, verbose, listing, login, user, idor,
redirect, regex, xml, burst, metadata, fetch, graphql, options), detail what it was asked with (payload, path, name).
Header names are compared without case; repeated headers stay apart. Each check returns (target, rule_id, severity,
confidence, endpoint, evidence). Checks of the first response are one array of conditional findings, exploded: one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.functions import catalog as K
from sparkwarden.functions.advice import web_advice
from sparkwarden.functions.text import host, join_url, scheme, unbase64url
from sparkwarden.operators.findings import rank

OUT = ("target", "rule_id", "severity", "confidence", "endpoint", "evidence")
DEFAULT_CONFIDENCE = 0.8


def header(name: str) -> Column:
    """The first value of a header, '' if absent."""
    found = F.filter("headers", lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.try_element_at(found, F.lit(1)).getField("value"), F.lit(""))


def all_headers(name: str) -> Column:
    return F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def finding(rule, severity, confidence: float | Column = DEFAULT_CONFIDENCE, evidence="", endpoint=None) -> Column:
    """One finding as a struct; evidence is cut at 500 characters, an empty endpoint is the target."""
    lit = lambda x, t="string": (x if isinstance(x, Column) else F.lit(x)).cast(t)
    where = F.col("target") if endpoint is None else F.coalesce(F.nullif(lit(endpoint), F.lit("")), F.col("target"))
    return F.struct(lit(rule).alias("rule_id"), lit(severity).alias("severity"), lit(confidence, "double").alias("confidence"), where.alias("endpoint"), F.substring(lit(evidence), 1, 500).alias("evidence"))


def emit(rows: DataFrame, *found: Column) -> DataFrame:
    """The findings among the given structs that are not null."""
    out = rows.select("target", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return out.select("target", *[F.col(f"f.{c}").alias(c) for c in OUT[1:]])


def any_of(c: Column, patterns) -> Column:
    """Whether any pattern is found, case ignored."""
    return reduce(lambda a, b: a | b, [c.rlike(f"(?dUi){p}") for p in patterns])


def probes(r: DataFrame, *kinds: str) -> DataFrame:
    """The answered responses to these probes."""
    return r.where(F.col("probe").isin(*kinds) & (F.col("status_code") != 0))


def roots(r: DataFrame) -> DataFrame:
    return probes(r, "root")


def per_row(*kinds: str):
    """A check that judges each response to these probes by itself: from its list of conditional findings."""
    def wrap(columns: Callable[[], list[Column]]) -> Callable[[DataFrame], DataFrame]:
        def check(r: DataFrame) -> DataFrame:
            return emit(probes(r, *kinds), *columns())

        check.__name__, check.__doc__, check.kinds, check.columns = columns.__name__, columns.__doc__, kinds, columns
        return check

    return wrap


def unreachable(r: DataFrame) -> DataFrame:
    rows = r.where((F.col("probe") == "root") & (F.col("status_code") == 0))
    return emit(rows, finding("DAST-CONNECTION-ERROR", "LOW", 1.0, "no response"))


@per_row("root")
def security_headers() -> list[Column]:
    hsts = header("Strict-Transport-Security")
    age = F.regexp_extract(hsts, r"(?i)max-age=(\d+)", 1)
    missing = [F.when(header(n) == "", finding("DAST-" + n.upper().replace("-", "_"), sev, 0.95, f"{n} is not set")) for n, _, sev in K.REQUIRED_HEADERS]
    odd = F.when((hsts != "") & ~F.lower(hsts).contains("max-age="), finding("DAST-HSTS-NO-MAX-AGE", "MEDIUM", evidence=hsts))
    low = F.when((age != "") & (age.try_cast("decimal(38,0)") < 10886400), finding("DAST-HSTS-LOW-MAX-AGE", "LOW", evidence=hsts))
    return [*missing, odd, low]


def _cookies(r: DataFrame) -> DataFrame:
    rows = roots(r).select("target", F.explode(all_headers("Set-Cookie")).alias("cookie"))
    return rows.withColumn("lower", F.lower("cookie")).withColumn("name", F.split_part("cookie", F.lit("="), F.lit(1)))


def cookies(r: DataFrame) -> DataFrame:
    """Flags that a cookie lacks. Each Set-Cookie header is judged by itself."""
    lacks = lambda flag, rule, severity: F.when(~F.col("lower").contains(flag), finding(rule, severity, evidence=F.substring("cookie", 1, 200)))
    return emit(_cookies(r), lacks("secure", "DAST-COOKIE-NO-SECURE", "HIGH"), lacks("httponly", "DAST-COOKIE-NO-HTTPONLY", "MEDIUM"), lacks("samesite", "DAST-COOKIE-NO-SAMESITE", "MEDIUM"))


# --- fixed values: parts of the names of session cookies ---
SESSION_NAMES = ("session", "sid", "token", "jwt")


def cookie_prefixes(r: DataFrame) -> DataFrame:
    low = F.lower("name")
    session = reduce(lambda a, b: a | b, [low.contains(s) for s in SESSION_NAMES])
    bare = F.col("cookie").contains("=") & session & ~F.col("name").startswith("__Host-") & ~F.col("name").startswith("__Secure-")
    return emit(_cookies(r), F.when(bare, finding("DAST-COOKIE-PREFIX", "LOW", 0.6, F.substring("cookie", 1, 150))))


@per_row("cors")
def cors() -> list[Column]:
    origin, allowed = header("Access-Control-Allow-Origin"), F.lower(header("Access-Control-Allow-Credentials")) == "true"
    return [
        F.when(origin == "*", finding("DAST-CORS-WILDCARD", "HIGH", 0.9, origin)),
        F.when(origin.startswith("http://"), finding("DAST-CORS-HTTP-ORIGIN", "MEDIUM", 0.8, origin)),
        F.when(~origin.isin("", "*") & allowed, finding("DAST-CORS-WITH-CREDENTIALS", "MEDIUM", 0.7, origin)),
    ]


@per_row("root")
def transport() -> list[Column]:
    secure = scheme(F.col("target")) == "https"
    weak = finding("DAST-WEAK-TLS", F.when(F.col("tls_rank") >= 4, "HIGH").otherwise("MEDIUM"), evidence=F.col("tls_version"))
    return [
        F.when(~secure, finding("DAST-NO-HTTPS", "HIGH", 1.0, F.col("target"))),
        F.when(secure & F.col("tls_version").isNull(), finding("DAST-TLS-CONNECTION-FAILED", "HIGH", 1.0, host(F.col("target")))),
        F.when(secure & F.col("tls_version").isNotNull() & (F.col("tls_rank") >= 3), weak),
    ]


@per_row("root")
def server_info() -> list[Column]:
    server, powered = header("Server"), header("X-Powered-By")
    return [
        F.when(server != "", finding("DAST-SERVER-INFO-DISCLOSURE", "LOW", 0.9, server)),
        F.when(powered != "", finding("DAST-X-POWERED-BY", "LOW", 0.9, powered)),
        F.when(any_of(F.col("body"), K.DEBUG_BODY), finding("DAST-DEBUG-MODE", "HIGH", 0.8, "debug output")),
    ]


# --- reflections ---------------------------------------------------------------------------------------------------------


def _around(body: Column, payload: Column, window: int = 50) -> Column:
    """What stands around the payload's first place, white space collapsed, at most 120 characters; '' without one."""
    at = F.position(payload, body)
    start = F.greatest(F.lit(1), at - window)
    cut = F.substr(body, start, at - start + F.length(payload) + window)
    return F.when(at > 0, F.substring(F.trim(F.regexp_replace(cut, r"(?U)\s+", " ")), 1, 120)).otherwise("")


def in_error(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in K.ERROR_PHRASES])


def executable(c: Column, payload: Column) -> Column:
    """Whether a payload stands where markup runs it: a script, a handler, inside or just before the end of a tag, or a link's value.

    Each place of the payload counts. The text is split at it: what precedes a place is all parts up to it, joined again.
    """
    low, head = F.lower(c), F.substring(payload, 1, 20)
    parts = F.split(c, F.concat(F.lit(r"\Q"), F.replace(head, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(-1))
    places = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    before = lambda k: F.call_function("array_join", F.slice(parts, F.lit(1), k), head)
    after = lambda k: F.call_function("array_join", F.slice(parts, k + 1, F.size(parts)), head)
    tagged = (head != "") & (F.size(parts) > 1) & F.exists(places, lambda k: before(k).rlike(r"<[a-zA-Z][^>]*$") | F.contains(after(k), F.lit(">")))
    value = lambda a: F.regexp_extract(c, rf"(?is)^.*?{a}=[^\"]*(\"[^\"]*\")", 1)
    linked = reduce(lambda a, b: a | b, [low.contains(f"{a}=") & F.contains(value(a), head) for a in ("href", "src", "action", "data", "formaction")])
    return low.contains("<script") | low.rlike(r"on\w+\s*=") | tagged | linked


def _reflected(r: DataFrame, kind: str) -> DataFrame:
    rows = probes(r, kind).withColumn("kind", F.split_part("detail", F.lit("|"), F.lit(1)))
    rows = rows.withColumn("payload", F.expr("substring(detail, length(kind) + 2)")).where(F.contains("body", "payload"))
    rows = rows.withColumn("context", _around(F.col("body"), F.col("payload")))
    return rows.withColumn("runs", executable(F.col("context"), F.col("payload"))).withColumn("error", in_error(F.col("context")))


def _times(body: Column, part: Column) -> Column:
    return (F.length(body) - F.length(F.replace(body, part, F.lit("")))) / F.length(part)


def injections(r: DataFrame) -> DataFrame:
    """Reflected payloads by kind. The score weighs how many came back, where, and how often each stands in its own response."""
    rows = _reflected(r, "injection").withColumn("times", _times(F.col("body"), F.col("payload")))
    agg = rows.groupBy("target", "kind").agg(
        F.count("*").alias("n"), F.countDistinct("context").alias("places"), F.every("error").alias("errors"), F.bool_or("runs").alias("runs"),
        F.sum("times").alias("times"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda s: s["payload"]), 1, 3), ", ").alias("first"),
    )
    bonus = lambda cond, by: F.when(cond, by).otherwise(0.0)
    raw = 0.4 + bonus(F.col("n") >= 2, 0.25) + bonus(F.col("places") >= 2, 0.1) - bonus(F.col("errors") & (F.col("n") < 3), 0.2) + bonus(F.col("runs"), 0.15) + bonus(F.col("times") > 2 * F.col("n"), 0.1)
    table = F.create_map(*[F.lit(x) for k, (sev, _, _) in K.INJECTIONS.items() for x in (k, sev)])
    evidence = F.concat("first", F.when(F.col("n") > 3, F.concat(F.lit(" (+"), (F.col("n") - 3).cast("string"), F.lit(" more)"))).otherwise(""))
    score = F.round(F.least(raw, F.lit(0.95)), 4)
    return emit(agg, finding(F.concat(F.lit("DAST-INJECTION-"), F.upper("kind")), F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("HIGH")), score, evidence))


# --- fixed values: tags that mark an HTML body ---
HTML_TAGS = ("<html", "<body", "<div", "<p>", "<h1", "<table")


def markup(r: DataFrame) -> DataFrame:
    rows = _reflected(r, "markup").withColumn("html", reduce(lambda a, b: a | b, [F.contains(F.lower("body"), F.lit(t)) for t in HTML_TAGS]))
    agg = rows.groupBy("target").agg(
        F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.every("error").alias("errors"), F.bool_or("runs").alias("runs"), F.bool_or("html").alias("html"), F.max("context").alias("best")
    )
    bonus = lambda cond, by: F.when(cond, by).otherwise(0.0)
    raw = 0.4 + bonus(F.col("n") >= 2, 0.2) + bonus(F.col("n") >= 3, 0.1) + bonus(F.col("runs"), 0.2) + bonus(F.col("kinds") >= 2, 0.1) + bonus(F.col("html"), 0.1) - bonus(F.col("errors"), 0.2)
    return emit(agg, finding("DAST-XSS-REFLECTED", "HIGH", F.round(F.least(raw, F.lit(0.95)), 4), F.col("best")))


@per_row("template")
def template() -> list[Column]:
    body = F.col("body")
    severity = F.when(body.rlike(r"(?U)49\b"), "CRITICAL").when(body.contains("{#"), "MEDIUM")
    return [F.when(severity.isNotNull(), finding("DAST-SSTI", severity, 0.6, "template output"))]


# --- endpoints -----------------------------------------------------------------------------------------------------------


@per_row("path")
def path_tiers() -> list[Column]:
    path, body = F.col("detail"), F.col("body")
    told = lambda severity, confidence: F.struct(F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    known = [F.when((path == p) & (body.rlike(pattern) if pattern else F.lit(True)), told(severity, sure)) for p, pattern, severity, sure in K.KNOWN_PATHS]
    tiers = [F.when(reduce(lambda a, b: a | b, [path.startswith(p) for p in paths]), told(severity, K.OTHER_PATH[1])) for paths, severity in K.PATH_TIERS]
    tier = F.coalesce(*known, *tiers, told(*K.OTHER_PATH))
    severity, confidence = tier["severity"], tier["confidence"]
    name = F.regexp_replace(F.translate(F.upper(path), "/.", "__"), "^_+|_+$", "")
    found = finding(F.concat(F.lit("DAST-EXPOSED-"), name), severity, confidence, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")), path)
    return [F.when(F.col("status_code") < 400, found)]


def exposed_paths(r: DataFrame, budget: int | None = None) -> DataFrame:
    """Paths that answer below 400, by tier. budget: see budgeted() (none: all)."""
    return path_tiers(r if budget is None else budgeted(r, budget))


# --- fixed values: probes of addresses in the order in which they are sent, and the one that uses up no budget ---
SCHEDULE = ("root", "path", "verbose", "listing", "idor", "xml", "graphql")
FREE = "listing"


def budgeted(r: DataFrame, most: int) -> DataFrame:
    """The responses that a budget of `most` addresses a target leaves, over the whole schedule; other probes stay all.

    A probe is sent while fewer addresses than that were asked before it, the first response being one of them.
    """
    at = F.array_position(F.array(*map(F.lit, SCHEDULE)), F.col("probe"))
    before = Window.partitionBy("target").orderBy(at, "seq", "detail").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum(((at > 0) & (F.col("probe") != FREE)).cast("int")).over(before), F.lit(0))
    return r.withColumn("_asked", asked).where((at <= 1) | (F.col("_asked") < most)).drop("_asked")


@per_row("verbose")
def verbose_errors() -> list[Column]:
    names = F.create_map(*[F.lit(x) for p, n in K.VERBOSE_PROBES for x in (p, n)])
    rule = F.concat(F.lit("DAST-VERBOSE-ERROR-"), F.try_element_at(names, F.col("detail")))
    severity = F.when(F.col("status_code") >= 500, "HIGH").otherwise("MEDIUM")
    return [F.when(any_of(F.col("body"), K.ERROR_BODY) & rule.isNotNull(), finding(rule, severity, 0.85, F.substring("body", 1, 150), F.col("detail")))]


@per_row("listing")
def listings() -> list[Column]:
    hit = (F.col("status_code") == 200) & any_of(F.col("body"), K.LISTING_BODY)
    return [F.when(hit, finding("DAST-DIRECTORY-LISTING", "MEDIUM", 0.95, "listing", F.col("detail")))]


@per_row("login")
def plain_login() -> list[Column]:
    hit = (F.col("status_code") < 400) & any_of(F.col("body"), K.LOGIN_BODY) & (scheme(F.col("target")) != "https")
    return [F.when(hit, finding("DAST-LOGIN-OVER-HTTP", "CRITICAL", 0.95, "login form", "/login"))]


def user_enumeration(r: DataFrame) -> DataFrame:
    """Logins that answer names differently, by status or length."""
    agg = probes(r, "user").groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("status_code").alias("codes"), F.countDistinct(F.length("body")).alias("sizes"))
    return emit(agg, F.when((F.col("n") >= 2) & ((F.col("codes") > 1) | (F.col("sizes") > 1)), finding("DAST-USER-ENUMERATION", "MEDIUM", 0.5, "answers differ", "/login")))


@per_row("idor")
def direct_references() -> list[Column]:
    hit = (F.col("status_code") == 200) & any_of(F.col("body"), K.PERSONAL_BODY)
    return [F.when(hit, finding("DAST-IDOR-POTENTIAL", "HIGH", 0.5, "personal fields", F.col("detail")))]


@per_row("redirect")
def open_redirect() -> list[Column]:
    to = header("Location")
    return [F.when(F.col("status_code").isin(*K.REDIRECTS) & to.contains(K.REDIRECT_HOST), finding("DAST-OPEN-REDIRECT", "MEDIUM", 0.7, to))]


@per_row("regex")
def regex_load() -> list[Column]:
    return [
        F.when(any_of(F.col("body"), K.REDOS_BODY), finding("DAST-REDOS", "MEDIUM", 0.4, "pattern machinery shows")),
        F.when(F.col("elapsed_ms") > 5000, finding("DAST-REDOS-TIMING", "HIGH", 0.5, F.concat(F.col("elapsed_ms").cast("bigint").cast("string"), F.lit(" ms")))),
    ]


@per_row("root")
def parser_signs() -> list[Column]:
    kind = F.lower(header("Content-Type"))
    return [
        F.when(kind.contains("xml"), finding("DAST-XXE-POTENTIAL", "MEDIUM", 0.3, kind)),
        F.when(any_of(F.col("body"), K.SERIAL_BODY), finding("DAST-INSECURE-DESERIALIZATION", "MEDIUM", 0.35, "body")),
        F.when(kind.contains("application/x-java-serialized-object") | kind.contains("application/php-serialized"), finding("DAST-INSECURE-DESERIALIZATION", "MEDIUM", 0.35, kind)),
    ]


def xml_posts(r: DataFrame) -> DataFrame:
    taken = probes(r, "xml").where(F.col("status_code") < 500).groupBy("target").agg(F.min_by("detail", "seq").alias("path"))
    return emit(taken, finding("DAST-XXE-ENDPOINT", "HIGH", 0.5, "XML post accepted", F.col("path")))


def parsers(r: DataFrame) -> DataFrame:
    """XML and serialised objects: the first response's type and body, and the first path that takes an XML post."""
    return parser_signs(r).unionByName(xml_posts(r))


def graphql(r: DataFrame) -> DataFrame:
    hits = probes(r, "graphql").where((F.col("status_code") == 200) & F.col("body").contains("__schema")).groupBy("target").agg(F.min_by("detail", "seq").alias("path"))
    return emit(hits, finding("DAST-GRAPHQL-INTROSPECTION", "MEDIUM", 0.95, "schema returned", F.col("path")))


# --- tokens, rates, clouds -----------------------------------------------------------------------------------------------

# --- fixed values: cookies that may hold a token, how many tokens of a response are read, and a token's longest life in seconds ---
TOKEN_COOKIES, TOKENS, LONG_LIFE = ("token", "jwt", "access_token", "id_token", "session"), 5, 86_400


def tokens(r: DataFrame) -> DataFrame:
    """(target, place, token): bearer header, named cookies, body; the first five. A token in a body has three non-empty parts."""
    bearer = header("Authorization")
    cookie = F.array_join(all_headers("Set-Cookie"), "\n")
    named = [F.regexp_extract(cookie, rf"(?i){n}=([^;\n]+)", 1) for n in TOKEN_COOKIES]
    body = F.regexp_extract_all("body", F.lit(r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"), F.lit(1))
    every = F.filter(F.concat(F.array(F.regexp_extract(bearer, r"(?i)bearer\s+(\S+)", 1), *named), body), lambda t: t != "")
    return roots(r).select("target", F.posexplode(F.slice(every, 1, TOKENS)).alias("place", "token"))


def jwt(r: DataFrame, as_of: int) -> DataFrame:
    """Token faults, as of a moment in epoch seconds. An unreadable part counts as an empty object."""
    part = lambda k: unbase64url(F.split_part("token", F.lit("."), F.lit(k)))
    rows = tokens(r).where(F.col("token").contains(".")).withColumn("head", part(1)).withColumn("claims", part(2))
    read = lambda doc, name: F.get_json_object(doc, f"$.{name}")
    rows = rows.select("target", "place", read("head", "alg").alias("alg"), read("claims", "exp").alias("exp"), read("claims", "iss").alias("iss"), read("claims", "aud").alias("aud"))
    life = F.col("exp").try_cast("double") - F.lit(as_of)
    alg = F.coalesce("alg", F.lit(""))
    return emit(
        rows,
        F.when(alg.isin(*K.NO_ALGORITHM), finding("DAST-JWT-ALG-NONE", "CRITICAL", 1.0, alg)),
        F.when(alg.isin(*K.SHARED_ALGORITHMS), finding("DAST-JWT-SYMMETRIC-ALG", "MEDIUM", 0.6, alg)),
        F.when(alg.startswith(K.SWAPPED_PREFIX), finding("DAST-JWT-ALG-CONFUSION", "LOW", 0.3, alg)),
        F.when(F.col("exp").isNull(), finding("DAST-JWT-NO-EXPIRY", "HIGH", 0.9, "no exp")),
        F.when(life > LONG_LIFE, finding("DAST-JWT-LONG-LIVED", "MEDIUM", 0.7, F.col("exp"))),
        F.when(F.col("iss").isNull() | F.col("aud").isNull(), finding("DAST-JWT-MISSING-CLAIMS", "LOW", 0.5, F.concat_ws(", ", F.when(F.col("iss").isNull(), "iss"), F.when(F.col("aud").isNull(), "aud")))),
    )


def rate_limit(r: DataFrame) -> DataFrame:
    agg = r.where(F.col("probe") == "burst").groupBy("target").agg(F.every(F.col("status_code") == 200).alias("open"), F.avg("elapsed_ms").alias("ms"), F.count("*").alias("n"))
    return emit(agg.where("open and n >= 5"), finding("DAST-NO-RATE-LIMITING", "LOW", 0.4, F.concat(F.round("ms").cast("bigint").cast("string"), F.lit(" ms"))))


@per_row("metadata")
def metadata() -> list[Column]:
    return [F.when(F.col("status_code") < 500, finding(F.concat(F.lit("DAST-"), F.upper("detail"), F.lit("-METADATA-ACCESSIBLE")), "CRITICAL", 0.9, "answered"))]


@per_row("root", "fetch")
def fetchers() -> list[Column]:
    """Bodies that show fetching of given addresses, and probes that brought a cloud's metadata back."""
    body, first = F.col("body"), F.col("probe") == "root"
    got = (F.col("status_code") < 500) & reduce(lambda a, b: a | b, [body.contains(x) for x in K.METADATA_BODY])
    return [
        F.when(first & any_of(F.lower("body"), K.FETCH_BODY), finding("DAST-SSRF-INDICATOR", "MEDIUM", 0.3, "fetches addresses")),
        F.when(~first & got, finding("DAST-SSRF-CLOUD-METADATA", "CRITICAL", 0.95, "metadata returned")),
    ]


# --- policies and fingerprints -------------------------------------------------------------------------------------------


@per_row("root")
def content_policy() -> list[Column]:
    csp = header("Content-Security-Policy")
    found = F.array_join(F.array_compact(F.array(*[F.when(csp.rlike(pattern), name) for name, pattern in K.POLICY_TOKENS])), ", ")
    return [F.when(found != "", finding("DAST-CSP-INSECURE", "MEDIUM", 0.9, found))]


@per_row("options")
def methods() -> list[Column]:
    allow = F.upper(F.coalesce(F.nullif(header("Allow"), F.lit("")), header("Access-Control-Allow-Methods")))
    found = F.array_join(F.filter(F.array(*map(F.lit, K.UNSAFE_METHODS)), lambda m: F.contains(allow, m)), ", ")
    return [F.when(found != "", finding("DAST-HTTP-METHODS", "MEDIUM", 0.8, found))]


@per_row("root")
def frameworks() -> list[Column]:
    cookie = F.array_join(all_headers("Set-Cookie"), "\n")
    places = {"cookies as sent": cookie, "cookies": F.lower(cookie)}
    sign = lambda where, token: (places[where] if where in places else F.lower(header(where))).contains(token)
    every = lambda signs: reduce(lambda a, b: a & b, [sign(*x) for x in signs])
    seen = [F.when(reduce(lambda a, b: a | b, map(every, groups)), name) for name, groups in K.FRAMEWORKS]
    found = F.array_join(F.array_compact(F.array(*seen)), ", ")
    return [F.when(found != "", finding("DAST-FRAMEWORK-FINGERPRINT", "LOW", 0.7, found))]


def _sources(body: Column, most: int = 5) -> Column:
    tags = F.regexp_extract_all(body, F.lit(r"(?i)<script[^>]*src=[\"'](?:https?:)?//[^\"']+[\"'][^>]*>"), F.lit(0))
    bare = F.filter(tags, lambda t: ~F.contains(F.lower(t), F.lit("integrity=")))
    names = F.transform(bare, lambda t: F.substring(F.regexp_extract(t, r"(?i)src=[\"'](?:https?:)?//([^\"']+)", 1), 1, 60))
    return F.slice(F.sort_array(F.array_distinct(names)), 1, most)


@per_row("root")
def integrity() -> list[Column]:
    """Scripts of other hosts without an integrity hash; the evidence names the first five of them by name."""
    found = _sources(F.col("body"))
    return [F.when(F.size(found) > 0, finding("DAST-SRI-MISSING", "LOW", 0.85, F.array_join(found, ", ")))]


@per_row("root")
def websockets() -> list[Column]:
    low = F.lower("body")
    found = F.when(low.rlike("(?:ws|wss)://"), "address").when(low.rlike(r"new\s+websocket\s*\("), "constructor")
    return [F.when(found.isNotNull(), finding("DAST-WEBSOCKET", "LOW", 0.7, found))]


@per_row("root")
def sniffing() -> list[Column]:
    value = header("X-Content-Type-Options")
    return [F.when(F.lower(value) != "nosniff", finding("DAST-NO-NOSNIFF", "LOW", 0.9, value))]


CHECKS = {
    f.__name__: f
    for f in (
        unreachable, security_headers, cookies, cors, transport, server_info, injections, markup, template, exposed_paths, verbose_errors, listings, plain_login,
        user_enumeration, direct_references, open_redirect, regex_load, parsers, rate_limit, metadata, fetchers, graphql, content_policy, methods, frameworks,
        cookie_prefixes, integrity, websockets, sniffing,
    )
}


#: The parts that a check of two kinds is made of, and the one with an option, as they stand in a whole scan.
_PARTS = {"parsers": (parser_signs, xml_posts), "exposed_paths": (path_tiers,)}


def response_findings(r: DataFrame, as_of: int, skip: frozenset[str] = frozenset()) -> DataFrame:
    """Findings of all checks but those in skip, with the check's place as ord. A target without a first response has only that.

    All checks that judge a response by itself share one pass over the capture; only those that compare responses, or
    look at single cookies or tokens, take one of their own.
    """
    alive = r.where((F.col("probe") == "root") & (F.col("status_code") != 0)).select("target").distinct()
    checked = r.join(alive, "target", "left_semi")
    single, out = [], None
    for k, (name, check) in enumerate([*CHECKS.items(), ("jwt", lambda x: jwt(x, as_of))]):
        for part in () if name in skip else _PARTS.get(name, (check,)):
            if hasattr(part, "columns"):
                single += [F.struct(F.lit(k).cast("bigint").alias("ord"), F.when(F.col("probe").isin(*part.kinds), c).alias("f")) for c in part.columns()]
            else:
                rows = part(r if name == "unreachable" else checked).withColumn("ord", F.lit(k).cast("bigint"))
                out = rows if out is None else out.unionByName(rows)
    if single:
        rows = checked.where("status_code <> 0").select("target", F.explode(F.filter(F.array(*single), lambda x: x["f"].isNotNull())).alias("x"))
        rows = rows.select("target", *[F.col(f"x.f.{c}").alias(c) for c in OUT[1:]], "x.ord")
        out = rows if out is None else out.unionByName(rows)
    told = [c.alias(name) for name, c in web_advice(F.col("rule_id")).items()]
    return out.select(
        F.when(F.col("endpoint").startswith("/"), join_url(F.col("target"), F.col("endpoint"))).otherwise(F.col("endpoint")).alias("file_path"), F.lit(0).alias("line_number"), "severity", "rule_id", "confidence", *told,
        F.substring("evidence", 1, 120).alias("snippet"), F.lit("dast").alias("detection_method"), "endpoint", "evidence", "ord", "target", rank(F.col("severity")).alias("sev"),
    )
