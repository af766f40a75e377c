"""Credentials: known token formats, key/value pairs, PEM bodies, hex and random strings.

Formats are a rule table (prefix that is kept, body). Everything is one alternation per detector,
guarded by a cheap test, so a text without secrets is read once per detector.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan import lists
from veilspan.functions import text as tx
from veilspan.functions.regex import empty, findings, hits, inner, join_findings, let, one_of
from veilspan.lists import Context
from veilspan.schema import FINDINGS

# Public token formats: (kept prefix, body). The prefix stays in a surrogate.
TOKEN_RULES = (
    (r"gl(?:pat|dt|rt|cbt|ptt|ft|imt|agent|oas|soat)-", r"[A-Za-z0-9_\-]{20,}"),
    (r"github_pat_", r"[A-Za-z0-9_]{22,}"),
    (r"gh[pousr]_", r"[A-Za-z0-9]{36,}"),
    (r"(?:AKIA|ASIA|ABIA|ACCA)", r"[A-Z0-9]{16}"),
    (r"xox[abeoprs]-", r"[A-Za-z0-9\-]{10,}"),
    (r"xapp-", r"[A-Za-z0-9\-]{20,}"),
    (r"sk-ant-[a-z0-9]{2,8}-", r"[A-Za-z0-9_\-]{20,}"),
    (r"sk-(?:proj-|svcacct-|admin-)?", r"[A-Za-z0-9_\-]{20,}"),
    (r"[rs]k_(?:live|test)_", r"[A-Za-z0-9]{16,}"),
    (r"whsec_", r"[A-Za-z0-9+/=]{20,}"),
    (r"npm_", r"[A-Za-z0-9]{36}"),
    (r"pypi-", r"[A-Za-z0-9_\-]{50,}"),
    (r"dckr_pat_", r"[A-Za-z0-9_\-]{20,}"),
    (r"hv[sbr]\.", r"[A-Za-z0-9_\-]{24,}"),
    (r"hf_", r"[A-Za-z0-9]{30,}"),
    (r"K10", r"[0-9a-f]{64}::[a-z]+:[0-9a-f]{32}"),
    (r"token-[a-z0-9]{5}:", r"[a-z0-9]{54}"),
    (r"[0-9]{8,10}:AA", r"[A-Za-z0-9_\-]{33}"),
    (r"sig=", r"[A-Za-z0-9%+/]{40,}=?"),
)
PROVIDER_RULES = (
    (r"AIza", r"[A-Za-z0-9_\-]{35}"),
    (r"ya29\.", r"[A-Za-z0-9_\-]{20,}"),
    (r"SG\.", r"[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"),
    (r"SK", r"[0-9a-f]{32}"),
    (r"key-", r"[0-9a-f]{32}"),
    (r"do[opr]_v1_", r"[0-9a-f]{64}"),
    (r"dapi", r"[0-9a-f]{32}(?:-[0-9])?"),
    (r"pul-", r"[0-9a-f]{40}"),
    (r"NRAK-", r"[A-Z0-9]{27}"),
    (r"pat[A-Za-z0-9]{14}\.", r"[0-9a-f]{64}"),
    (r"gsk_", r"[A-Za-z0-9]{40,}"),
    (r"sb[ps]_", r"[A-Za-z0-9]{40}"),
    (r"[A-Za-z0-9]{14}\.atlasv1\.", r"[A-Za-z0-9_\-]{60,}"),
    (r"dp\.[a-z]{2,5}\.", r"[A-Za-z0-9]{40,}"),
    (r"lin_api_", r"[A-Za-z0-9]{40}"),
    (r"ntn_", r"[A-Za-z0-9]{43,}"),
    (r"glsa_", r"[A-Za-z0-9]{32}_[0-9a-f]{8}"),
    (r"glc_", r"[A-Za-z0-9+/=]{32,}"),
    (r"shp(?:at|ca|pa|ss)_", r"[0-9a-fA-F]{32}"),
    (r"sq0[a-z]{3}-", r"[A-Za-z0-9_\-]{22,}"),
    (r"PMAK-", r"[0-9a-f]{24}-[0-9a-f]{34}"),
    (r"figd_", r"[A-Za-z0-9_\-]{40,}"),
    (r"AGE-SECRET-KEY-1", r"[A-Z0-9]{58}"),
    (r"tskey-[a-z]+-", r"[A-Za-z0-9]+-[A-Za-z0-9]+"),
    (r"pscale_(?:tkn|pw|oauth)_", r"[A-Za-z0-9_.\-]{32,}"),
    (r"sntry[su]_", r"[A-Za-z0-9+/=_]{40,}"),
    (r"bkua_", r"[0-9a-f]{40}"),
    (r"ATATT3", r"[A-Za-z0-9_\-=]{60,}"),
    (r"EAAC", r"[A-Za-z0-9]{40,}"),
    (r"rubygems_", r"[0-9a-f]{48}"),
    (r"tfp_", r"[A-Za-z0-9_\-]{40,}"),
    (r"dnkey-", r"[a-z0-9=_\-]{26}-[a-z0-9=_\-]{52}"),
    (r"duffel_(?:test|live)_", r"[A-Za-z0-9_\-=]{43}"),
    (r"EZ[AT]K", r"[A-Za-z0-9]{54}"),
    (r"FLW(?:PUBK|SECK)_TEST-", r"[0-9a-h]{12,32}"),
    (r"shippo_(?:live|test)_", r"[0-9a-f]{40}"),
    (r"sl\.", r"[A-Za-z0-9_\-=]{130,}"),
    (r"xkeysib-", r"[0-9a-f]{64}-[A-Za-z0-9]{16}"),
    (r"xsmtpsib-", r"[0-9a-f]{64}-[A-Za-z0-9]{16}"),
    (r"GOCSPX-", r"[A-Za-z0-9_\-]{28}"),
    (r"1//0", r"[A-Za-z0-9_\-]{40,}"),
    (r"nvapi-", r"[A-Za-z0-9_\-]{60,}"),
    (r"pplx-", r"[A-Za-z0-9]{48}"),
    (r"xai-", r"[A-Za-z0-9]{80}"),
    (r"tvly-(?:dev-|prod-)?", r"[A-Za-z0-9]{32}"),
    (r"lsv2_(?:pt|sk)_", r"[0-9a-f]{32}_[0-9a-f]{10}"),
    (r"jina_", r"[A-Za-z0-9_\-]{50,}"),
    (r"r8_", r"[A-Za-z0-9]{37}"),
    (r"CFPAT-", r"[A-Za-z0-9_\-]{43}"),
    (r"ATBB", r"[A-Za-z0-9]{24,}"),
    (r"nfp_", r"[A-Za-z0-9]{36,}"),
    (r"rnd_", r"[A-Za-z0-9]{28,}"),
    (r"ph[cx]_", r"[A-Za-z0-9]{43}"),
    (r"oy2", r"[a-z0-9]{43}"),
    (r"CLOJARS_", r"[a-z0-9]{60}"),
    (r"sgp_(?:[0-9a-f]{16}_|local_)?", r"[0-9a-f]{40}"),
    (r"ops_eyJ", r"[A-Za-z0-9+/=_\-]{100,}"),
    (r"fo1_", r"[A-Za-z0-9_\-]{43}"),
    (r"fm[12][ar]?_", r"[A-Za-z0-9+/=]{100,}"),
    (r"LTAI", r"[A-Za-z0-9]{20}"),
    (r"AKID", r"[A-Za-z0-9]{32}"),
    (r"AQVN", r"[A-Za-z0-9_\-]{35,38}"),
    (r"EAAA", r"[A-Za-z0-9_\-]{60}"),
    (r"NRJS-", r"[0-9a-f]{19}"),
    (r"NRII-", r"[A-Za-z0-9_\-]{32}"),
    (r"NRRA-", r"[0-9a-f]{42}"),
    (r"eyJrIjoi", r"[A-Za-z0-9=]{70,}"),
    (r"fio-u-", r"[A-Za-z0-9_\-=]{64}"),
    (r"pnu_", r"[a-z0-9]{36}"),
    (r"dt0c01\.", r"[A-Z0-9]{24}\.[A-Z0-9]{64}"),
    (r"HRKU-", r"[A-Za-z0-9_\-]{36,}"),
    (r"pat-(?:na|eu|ap)[0-9]-", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    (r"access-(?:sandbox|development|production)-", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    (r"rdme_", r"[a-z0-9]{70}"),
    (r"samsara_api_", r"[A-Za-z0-9]{30}"),
    (r"SCW", r"[A-Z0-9]{17}"),
    (r"sm_(?:aat|pat|sat)_", r"[A-Za-z0-9]{16}"),
    (r"sq[apu]_", r"[0-9a-f]{40}"),
    (r"v1\.0-", r"[0-9a-f]{24}-[0-9a-f]{146}"),
    (r"zpka_", r"[0-9a-f]{32}_[0-9a-f]{8}"),
    (r"ico-", r"[A-Za-z0-9]{32}"),
    (r"[ps]at\.[A-Za-z0-9_\-]{22}\.", r"[0-9a-f]{24}\.[A-Za-z0-9]{20}"),
    (r"API-", r"[A-Z0-9]{26,}"),
    (r"AKCp", r"[A-Za-z0-9]{69}"),
    (r"cmVmdGtu", r"[A-Za-z0-9]{56}"),
    (r"(?:live|test)_", r"[0-9a-f]{35}"),
    (r"", r"[A-Za-z0-9]{6}_[A-Za-z0-9]{29}_mmk"),
    (r"", r"[0-9a-f]{32}-us[0-9]{1,2}"),
    (r"[ps]k\.", r"eyJ[A-Za-z0-9_\-]{50,}\.[A-Za-z0-9_\-]{22}"),
    (r"", r"[MNO][A-Za-z0-9]{23,25}\.[A-Za-z0-9_\-]{6}\.[A-Za-z0-9_\-]{27,38}"),
    (r"CCIPAT_", r"[A-Za-z0-9]{22}_[0-9a-f]{40}"),
    (r"AVNS_", r"[A-Za-z0-9]{19}"),
    (r"rzp_(?:live|test)_", r"[A-Za-z0-9]{14}"),
    (r"[sp]k_sbox_", r"[a-z0-9]{26,}"),
    (r"tr_(?:dev|prod|stg)_", r"[A-Za-z0-9]{20,}"),
    (r"apify_api_", r"[A-Za-z0-9]{34,}"),
    (r"kaggle_", r"[0-9a-f]{32,}"),
    (r"sdk-", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    (r"secret_", r"[A-Za-z0-9]{43}"),
    (r"cio", r"[A-Za-z0-9]{32}"),
)
# providers whose keys have no prefix of their own: provider word, then a plain value
KEYED_PROVIDERS = tuple("""
adafruit adobe algolia asana atlassian bitbucket bittrex codecov coinbase confluent contentful datadog discord
droneci dropbox etsy fastly finicity finnhub flickr gitter heroku hubspot intercom kraken kucoin launchdarkly
linkedin looker mailchimp mapbox mattermost messagebird netlify nytimes okta plaid sendbird sentry snyk
squarespace sumologic travisci trello twitch twitter typeform yandex zendesk
auth0 azure bitly braintree circleci clickup cloudflare cloudinary deepl firebase freshdesk gocardless jira jotform mailgun mailjet
newrelic nexmo notion onesignal openai opsgenie pagerduty paypal pinecone pipedrive pulumi pusher rollbar salesforce sendgrid shodan
stripe supabase surveymonkey trustpilot twilio vercel virustotal zapier
""".split())
JWT = r"eyJ[A-Za-z0-9_\-]{6,}\.eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]*"
# Java recurses per repetition of a group, so the pieces of one split token need a bound (stack, not meaning).
MOST_PIECES = 400
_L, _R = r"(?<![A-Za-z0-9_\-])", r"(?![A-Za-z0-9_\-])"


def _rule_pattern(rules) -> str:
    return _L + "(?:" + "|".join(p + b for p, b in rules) + ")" + _R


def _prefix_pattern(rules) -> str:
    return "^(?:" + "|".join(p for p, _b in rules) + ")"


def _keep(n: Column) -> Column:
    return F.create_map(F.lit("keep_prefix"), n.cast("string"))


# Every format is a run of at least 15 of these characters: one linear pass finds the runs, the
# long alternation of formats only sees them.
RUN = r"(?<![A-Za-z0-9_.:+/=%\-])[A-Za-z0-9_.:+/=%\-]{15,}"


def _in_runs(text: Column, pattern: str) -> Column:
    """Hits of ``pattern`` inside the long runs of a text."""
    def search(run: Column) -> Column:
        return F.transform(hits(run["text"], pattern), lambda h: F.struct(
            (run["start"] + h["start"]).cast("int").alias("start"), h["text"].alias("text")))

    return F.flatten(F.transform(hits(text, RUN), search))


def _rule_findings(text: Column, rules, detector: str, priority: int) -> Column:
    heads = _prefix_pattern(rules)
    return findings(_in_runs(text, _rule_pattern(rules)), "SECRET", detector, priority,
                    meta=lambda h: _keep(F.length(F.regexp_extract(h["text"], heads, 0))))


def _jwt(text: Column) -> Column:
    return findings(hits(text, _L + JWT, guard=F.contains(text, F.lit("eyJ"))), "SECRET", "tokens", 92,
                    meta=lambda h: _keep(F.length(F.substring_index(h["text"], ".", 1)) + 1))


def _jwt_payload(text: Column) -> Column:
    """A payload alone is a secret when it decodes to claims; a header alone is none."""
    claims = r"\"(?:sub|iss|aud|exp|iat|jti|nbf|name|email|scope)\"\s*:"
    found = hits(text, r"(?<![A-Za-z0-9_\-.])eyJ[A-Za-z0-9_\-]{12,}={0,2}(?![A-Za-z0-9_\-.])",
                 guard=F.contains(text, F.lit("eyJ")))
    return findings(found, "SECRET", "tokens", 92,
                    keep=lambda h: F.regexp_like(F.coalesce(tx.b64_decode(h["text"]), F.lit("")), F.lit(claims))
                    & ~F.contains(F.coalesce(tx.b64_decode(h["text"]), F.lit("")), F.lit('"alg"')))


def tokens(text: Column, ctx: Context) -> Column:
    return join_findings(_rule_findings(text, TOKEN_RULES, "tokens", 92), _jwt(text), _jwt_payload(text))


def providers(text: Column, ctx: Context) -> Column:
    """Provider formats: fixed prefixes, keyed values, and rules added through the context."""
    rules = (*PROVIDER_RULES, *[(r.get("prefix", ""), r["pattern"]) for r in ctx.token_rules])
    words = "|".join(KEYED_PROVIDERS)
    keyed = rf"(?i)\b(?:{words})[\w.\-]{{0,24}}[\"']?\s{{0,3}}(?:=|:|=>|:=)\s{{0,3}}[\"']?[A-Za-z0-9_\-]{{24,}}+(?![\w\-])"
    located = F.transform(
        hits(text, keyed, guard=F.regexp_like(text, F.lit(r"[:=>][ \t]{0,3}[\"']?[A-Za-z0-9_\-]{24}"))),
        lambda h: inner(h, r"(?is)^(.*?[=:>]\s*[\"']?)([A-Za-z0-9_\-]{24,})$", 2))
    mixed = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])"
    return join_findings(
        _rule_findings(text, rules, "gitleaks", 91),
        findings(located, "SECRET", "gitleaks", 91, keep=lambda h: F.regexp_like(h["text"], F.lit(mixed))))


def split_strings(text: Column, ctx: Context) -> Column:
    """A token written as several string literals: every piece that belongs to it is a finding."""
    literal = r"\"[^\"\n]{2,}+\"|'[^'\n]{2,}+'"
    glue = r"[ \t]{0,8}[+&.,]?[ \t]{0,8}_?\s{0,40}"
    runs = hits(text, rf"(?:{literal})(?:{glue}(?:{literal})){{1,{MOST_PIECES}}}",
                guard=F.regexp_like(text, F.lit(r"[\"'][ \t]*[+&.,]?[ \t]*_?\s*[\"']")))
    token = JWT + "|" + "|".join(p + b for p, b in TOKEN_RULES)

    def pieces(run: Column) -> Column:
        def within(parts: Column) -> Column:
            bodies = F.transform(parts, lambda p: F.struct(
                (run["start"] + p["start"] + 1).cast("int").alias("start"),
                F.substring(p["text"], F.lit(2), F.length(p["text"]) - 2).alias("text")))

            def match(bs: Column) -> Column:
                joined = F.array_join(F.transform(bs, lambda b: b["text"]), "")

                def locate(v: Column) -> Column:
                    header = F.when(F.startswith(v["tok"], F.lit("eyJ")),
                                    F.length(F.substring_index(v["tok"], ".", 1)) + 1).otherwise(0)
                    first = F.instr(v["all"], v["tok"]) - 1 + header
                    last = F.instr(v["all"], v["tok"]) - 1 + F.length(v["tok"])

                    def offset(i: Column) -> Column:
                        return F.aggregate(F.slice(bs, 1, i), F.lit(0), lambda a, b: a + F.length(b["text"]))

                    marked = F.transform(bs, lambda b, i: F.struct(
                        b["start"].alias("start"), b["text"].alias("text"),
                        ((offset(i) < last) & (offset(i) + F.length(b["text"]) > first)).alias("hit")))
                    return F.when((v["tok"] != ""), F.filter(marked, lambda m: m["hit"])).otherwise(
                        empty("array<struct<start:int,text:string,hit:boolean>>"))

                def instr_ready(j: Column) -> Column:
                    return let(F.struct(j.alias("all"), F.regexp_extract(j, token, 0).alias("tok")), locate)

                return let(joined, instr_ready)

            return let(bodies, match)

        return within(hits(run["text"], literal))

    return findings(F.flatten(F.transform(runs, pieces)), "SECRET", "split-strings", 93)


# ---------------------------------------------------------------- key/value pairs
_SECRET_WORD = (
    r"(?:pass(?:word|wd|phrase|wort)?|pwd|kennwort|secret|token|credentials?|api[_.\-]?key|access[_.\-]?key|"
    r"secret[_.\-]?key|private[_.\-]?key|auth[_.\-]?key|encryption[_.\-]?key|account[_.\-]?key|shared[_.\-]?access[_.\-]?key)"
)
_KEY = rf"(?<![A-Za-z0-9_.\-$])[A-Za-z0-9_.\-]{{0,60}}{_SECRET_WORD}"
_QUOTED = rf"(?i){_KEY}(?:\\?[\"'])?[ \t]{{0,8}}(?:=>|:=|[:=])[ \t]{{0,8}}(?:(\\?\")[^\"\n]+?\1|'[^'\n]++')"
_BARE = rf"(?i){_KEY}[ \t]{{0,8}}(?:=>|:=|[:=])[ \t]{{0,8}}[^\s\"'`,;<>|{{}}]++"
_XML = rf"(?i)<(?:\w{{1,20}}:)?([A-Za-z0-9_.\-]{{0,60}}{_SECRET_WORD})>[^<\n]++(?=</)"
_FLAG = rf"(?i)(?<![\w\-])--?[A-Za-z0-9\-]{{0,40}}{_SECRET_WORD}(?:=|[ \t]{{1,4}})[\"']?[^\s\"'`<>|]++"
_URL_USER = r"(?U)[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s/:@\"'<>]*+:[^\s/@\"'<>]++(?=@)"
_BEARER = r"(?i)authorization[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?(?:bearer|basic|token)[ \t]{1,4}[A-Za-z0-9._~+/=\-]{8,}"
# administration commands: (lead that is kept, value behind it); the leads start with distinct words. A value has
# no maximum; its option stands up to 2,000 characters behind the command word.
COMMAND_RULES = (
    (r"\bmysql(?:dump|admin)?\b[^\n|;]{0,2000}?[ \t]-p(?=[^\s\-])", r"[^\s\"']{2,}+"),
    (r"\bcurl\b[^\n|;]{0,2000}?[ \t](?:-u|--user)[ \t]{0,2}[\"']?[^\s:\"']{1,60}:", r"[^\s\"']++"),
    (r"\bsshpass[ \t]+-p[ \t]{0,2}[\"']?", r"[^\s\"']++"),
    (r"\bConvertTo-SecureString[ \t]+(?:-String[ \t]+)?[\"']", r"[^\"'\n]++(?=[\"'])"),
    (r"\bnet[ \t]+user[ \t]+[^\s/]{1,60}[ \t]+(?![/*])", r"[^\s]{3,}+"),
    (r"\bnet[ \t]+use\b[^\n]{0,2000}?/user:[^\s]{1,60}[ \t]+(?![/*])", r"[^\s]{3,}+"),
    (r"\bIDENTIFIED[ \t]+(?:WITH[ \t]+\S{1,40}[ \t]+)?BY[ \t]+'", r"[^'\n]++(?=')"),
    (r"\b(?:USER|ROLE|SET)\b[^\n;]{0,2000}?\bPASSWORD[ \t]*=?[ \t]*'", r"[^'\n]++(?=')"),
    (r"\b(?:requirepass|masterauth)[ \t]+", r"[^\s\"']{3,}+"),
    (r"\bredis-cli\b[^\n|;]{0,2000}?[ \t]-a[ \t]+", r"[^\s\"']{3,}+"),
    (r"\bldap(?:search|modify|add|passwd|whoami|delete)\b[^\n|;]{0,2000}?[ \t]-w[ \t]+[\"']?", r"[^\s\"']{3,}+"),
    (r"\bopenssl\b[^\n|;]{0,2000}?[ \t\"']pass:", r"[^\s\"']++"),
    (r"\bsmbclient\b[^\n|;]{0,2000}?-U[ \t]{0,2}[\"']?[^\s%\"'`]{1,60}%", r"[^\s\"'`,]{3,}+"),
    (r"\bx?freerdp\b[^\n|;]{0,2000}?[ \t]/p:[\"']?", r"[^\s\"']{3,}+"),
    (r"\bp(?:link|scp)(?:\.exe)?\b[^\n|;]{0,2000}?[ \t]-pw[ \t]+(?!\()", r"[^\s\"']{3,}+"),
    (r"\b(?:psexec|docker[ \t]+login)\b[^\n|;]{0,2000}?[ \t]-p[ \t]+[\"']?", r"[^\s\"']{3,}+"),
    (r"\b(?:password|secret)[ \t]+[0-9][ \t]+", r"[^\s\"']{5,}+"),
)
_HASH = r"(?<![\w$])\$(?:1|5|6|7|2[abxy]|apr1|y|gy|8|9|argon2id?|sha1)\$[A-Za-z0-9./$,=+\-]{12,}+"
_CODE_VALUE = (
    r"^(?:[A-Za-z_][\w.\[\]]*\(|(?:self|this|os|sys|env|process|config|settings|request|response|options|args|data|var"
    r"|local|module|secrets|vars|values|inputs|steps|github|each|each\.value)\.|[A-Z][a-z]+(?:[A-Z][a-z]+)*$"
    r"|[A-Za-z_]\w*\[|\w+::|->|&[A-Za-z_]|[A-Za-z]+\.[A-Za-z]+\.[A-Za-z.]+$)"
)
_VARIABLE = r"^(?:\$[\w{(]|%[\w]+%|<.*>?$|\{\{|\[\[|\(\(|!\w|\*+$|x+$|\.{2,}|#\{|@\w+@|&lt;)"
_NAMING_VALUE = r"(?i)^[a-z0-9.]+(?:-[a-z0-9.]+)*-(?:credentials?|secrets?|token|password|auth|key|cert|tls)$"


def _plausible_value(value: Column) -> Column:
    low = F.lower(value)
    return (
        (F.length(F.trim(value)) >= 3)
        & ~one_of(low, (*lists.PLACEHOLDER_VALUES, "bearer", "basic", "plink", "str", "string", "int", "bool", "bytes",
                        "required:", "any", "self", "env", "vault"))
        & ~F.regexp_like(value, F.lit(_VARIABLE))
        & ~F.regexp_like(value, F.lit(_NAMING_VALUE))
    )


def _bare_value(value: Column) -> Column:
    """Cut an unquoted value at the bracket it did not open and drop punctuation behind it."""
    out = value
    for opened, closed in (("(", ")"), ("[", "]"), ("{", "}")):
        out = _cut_at(out, opened, closed)
    return F.regexp_replace(out, r"[.,;:!?`]+$", "")


def _cut_at(value: Column, opened: str, closed: str) -> Column:
    def cut(v: Column) -> Column:
        first = F.substring_index(v, closed, 1)
        return F.when(F.contains(v, F.lit(closed)) & ~F.contains(first, F.lit(opened)), first).otherwise(v)

    return let(value, cut)


def _not_a_secret_key(key: Column) -> Column:
    return F.regexp_like(key, F.lit(
        r"(?i)(?:publickeytoken|existing[_-]?secret|(?:^|[_.\-])(?:no|without|has|is|use|csrf|next|prev|page|max|min|num)"
        r"[_.\-]?(?:secret|token|password)s?|https?|public[_.\-]?key)$"))


def kv_secrets(text: Column, ctx: Context) -> Column:
    split_kv = r"(?is)^([^=:]*?(?:\\?[\"'])?[ \t]*(?:=>|:=|[:=])[ \t]*)(.*)$"

    def quoted(h: Column) -> Column:
        part = inner(h, r"(?is)^([A-Za-z0-9_.\-]+(?:\\?[\"'])?[ \t]*(?:=>|:=|[:=])[ \t]*\\?[\"'])(.*?)\\?[\"']$", 2)
        return F.struct(part["start"], part["text"], F.regexp_extract(h["text"], r"^([A-Za-z0-9_.\-]+)", 1).alias("key"))

    def bare(h: Column) -> Column:
        part = inner(h, split_kv, 2)
        return F.struct(part["start"], _bare_value(part["text"]).alias("text"),
                        F.regexp_extract(h["text"], r"^([A-Za-z0-9_.\-]+)", 1).alias("key"))

    # the word stands right in front of a separator: test the rare separators, look back from there
    word = F.regexp_like(text, F.lit(rf"[:=](?<=(?i:{_SECRET_WORD})\\{{0,1}}[\"']{{0,1}}[ \t]{{0,8}}[:=])"))
    element = F.regexp_like(text, F.lit(rf">(?<=(?i:{_SECRET_WORD})>)"))
    flag = F.regexp_like(text, F.lit(rf"--?[A-Za-z0-9\-]{{0,40}}(?<=(?i:{_SECRET_WORD}))[= \t]"))

    def good(h: Column) -> Column:
        return _plausible_value(h["text"]) & ~_not_a_secret_key(h["key"])

    pairs = join_findings(
        findings(F.transform(hits(text, _QUOTED, guard=word), quoted), "SECRET", "kv-secrets", 88, keep=good),
        findings(F.transform(hits(text, _BARE, guard=word), bare), "SECRET", "kv-secrets", 88,
                 keep=lambda h: good(h) & ~F.regexp_like(h["text"], F.lit(_CODE_VALUE))),
        findings(F.transform(hits(text, _XML, guard=element), lambda h: inner(h, r"(?s)^([^>]*>)(.*)$", 2)),
                 "SECRET", "kv-secrets", 88, keep=lambda h: _plausible_value(h["text"])),
        findings(F.transform(hits(text, _FLAG, guard=flag),
                             lambda h: inner(h, r"(?is)^(--?[A-Za-z0-9\-]+(?:=|[ \t]+)[\"']?)(.*)$", 2)),
                 "SECRET", "kv-secrets", 88,
                 keep=lambda h: _plausible_value(h["text"]) & ~F.startswith(h["text"], F.lit("-"))))

    def url_part(h: Column, group: int) -> Column:
        if group == 1:
            return inner(h, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://)([^:]*)", 2)
        return inner(h, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^:]*:)(.*)$", 2)

    urls = let(hits(text, _URL_USER, guard=F.contains(text, F.lit("://"))), lambda found: join_findings(
        findings(F.transform(found, lambda h: url_part(h, 1)), "USERNAME", "kv-secrets", 88,
                 keep=lambda h: (h["text"] != "") & ~one_of(F.lower(h["text"]), lists.SKIP_USERNAMES)),
        findings(F.transform(found, lambda h: url_part(h, 2)), "SECRET", "kv-secrets", 88,
                 keep=lambda h: _plausible_value(h["text"]))))
    bearer = findings(
        F.transform(hits(text, _BEARER, guard=F.regexp_like(text, F.lit("(?i)\\bauthorization"))),
                    lambda h: inner(h, r"(?is)^(.*(?:bearer|basic|token)[ \t]+)(.*)$", 2)),
        "SECRET", "kv-secrets", 88, keep=lambda h: _plausible_value(h["text"]))
    hashes = findings(hits(text, _HASH, guard=F.contains(text, F.lit("$"))), "SECRET", "kv-secrets", 88,
                      meta=lambda h: _keep(F.length(F.regexp_extract(h["text"], r"^\$[A-Za-z0-9]+\$", 0))))
    command_word = F.regexp_like(text, F.lit(
        r"(?i)\b(?:mysql|curl|sshpass|ConvertTo|net[ \t]|identified|password|requirepass|masterauth|redis-cli|ldap|openssl|"
        r"smbclient|x?freerdp|plink|pscp|psexec|docker|secret)"))
    every = "(?i)(?:" + "|".join(lead + value for lead, value in COMMAND_RULES) + ")"
    leads = "(?is)^(" + "|".join(lead for lead, _value in COMMAND_RULES) + ")(.*)$"
    commands = findings(
        F.transform(hits(text, every, guard=command_word), lambda h: inner(h, leads, 2)),
        "SECRET", "kv-secrets", 88, keep=lambda h: _plausible_value(h["text"]))
    return join_findings(pairs, urls, bearer, hashes, commands)


# ---------------------------------------------------------------- PEM, hex, random
def pem(text: Column, ctx: Context) -> Column:
    """Bodies of private keys and certificates, also with escaped line ends and as Base64."""
    block = r"(?s)-----BEGIN (?!PUBLIC)[A-Z0-9 ]{0,40}(?:PRIVATE KEY(?: BLOCK)?|CERTIFICATE)-----.+?-----END [A-Z0-9 ]{4,60}-----"
    edge = r"(?:\s|\\[nrt]){0,64}"

    def body(h: Column) -> Column:
        part = inner(h, rf"(?s)^(-----BEGIN [A-Z0-9 ]+-----{edge})(.*?){edge}-----END [A-Z0-9 ]+-----$", 2)
        return F.struct(part["start"], part["text"],
                        F.contains(F.substring_index(h["text"], "-----", 2), F.lit("CERTIFICATE")).alias("cert"))

    def encoded(h: Column) -> Column:
        plain = F.coalesce(tx.b64_decode(h["text"]), F.lit(""))
        return F.struct(h["start"], h["text"], F.contains(plain, F.lit("CERTIFICATE")).alias("cert"),
                        F.regexp_like(plain, F.lit("BEGIN [A-Z0-9 ]*(?:PRIVATE KEY|CERTIFICATE)")).alias("ok"))

    def typed(found: Column, keep=None) -> Column:
        kept = F.filter(found, keep) if keep else found
        return let(kept, lambda k: join_findings(
            findings(F.filter(k, lambda h: ~h["cert"]), "PRIVATE_KEY", "pem", 95),
            findings(F.filter(k, lambda h: h["cert"]), "CERTIFICATE", "pem", 95)))

    b64 = r"(?<![A-Za-z0-9+/=])LS0tLS1CRUdJTi[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=])"
    return join_findings(
        typed(F.transform(hits(text, block, guard=F.contains(text, F.lit("-----BEGIN"))), body),
              lambda h: F.trim(h["text"]) != ""),
        typed(F.transform(hits(text, b64, guard=F.contains(text, F.lit("LS0tLS1CRUdJTi"))), encoded), lambda h: h["ok"]))


def hex_strings(text: Column, ctx: Context) -> Column:
    before = r"(?i)(?:(?:sha-?(?:1|224|256|384|512)|md5|digest|etag|checksum|integrity|commit|rev|revision|hash|tree|parent|publickeytoken)[\"']?\s{0,3}[:=@]?\s{0,3}[\"']?|/(?:commits?|blob|tree|gist|raw)/)$"
    found = hits(text, r"(?<![A-Za-z0-9_+=.\-])[0-9A-Fa-f]{32,}(?![A-Za-z0-9_+/=\-]|\.[A-Za-z0-9])", before=24, after=8,
                 guard=F.regexp_like(text, F.lit("[0-9A-Fa-f]{32}")))
    return findings(found, "SECRET", "hex-strings", 66,
                    keep=lambda h: ~F.regexp_like(h["before"], F.lit(before))
                    & ~F.regexp_like(h["after"], F.lit(r"^(?:  | \*)[\w./-]"))
                    & ~F.regexp_like(h["text"], F.lit(r"^(.)\1*$")))


def _random(value: Column) -> Column:
    """Mixed case with digits, no words, short runs of one kind, enough different characters."""
    core = F.regexp_replace(value, "^[a-z]{2,12}_", "")
    return (
        F.regexp_like(core, F.lit("[a-z]")) & F.regexp_like(core, F.lit("[A-Z]"))
        & (F.length(F.regexp_replace(core, "[^0-9]", "")) >= 2)
        & ~F.regexp_like(core, F.lit("[a-z]{7}|[A-Z]{8}|[0-9]{9}|[A-Z]?[a-z]{4,}[A-Z][a-z]{4,}"))
        & (F.size(F.array_distinct(tx.chars(core))) >= 10)
    )


def random_tokens(text: Column, ctx: Context) -> Column:
    """Unknown formats: 30 and more random characters, or a value that is the whole text."""
    not_id = r"(?i)(?:sha(?:1|256|384|512)-|sha(?:1|256|384|512):|ssh-(?:rsa|ed25519)\s{1,2}|base64,|[?&](?:list|v|id)=)$"
    found = hits(text, r"(?<![A-Za-z0-9_+/.\-])[A-Za-z0-9_+\-]{30,}={0,2}(?![A-Za-z0-9_+/=\-])", before=14,
                 guard=F.regexp_like(text, F.lit(r"(?<![A-Za-z0-9_+/.\-])[A-Za-z0-9_+\-]{30}")))
    inside = findings(
        found, "SECRET", "random-tokens", 63,
        keep=lambda h: _random(h["text"]) & ~F.regexp_like(h["before"], F.lit(not_id))
        & ~F.regexp_like(h["text"], F.lit(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        meta=lambda h: _keep(F.length(F.regexp_extract(h["text"], "^[a-z]{2,12}_", 0))))
    alone = F.trim(text)
    lead = F.length(F.regexp_extract(text, r"(?U)^\s*", 0))
    symbols = F.regexp_like(alone, F.lit(r"^(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[!-~]{10,}$")) & F.regexp_like(
        alone, F.lit(r"[!#$%&*+=?@^~]")) & ~F.regexp_like(alone, F.lit(r"://|^[^@]+@[^@]+\.[a-z]+$|[(){}\[\];]|^[A-Za-z_]\w*="))
    plain = F.regexp_like(alone, F.lit(r"^[A-Za-z0-9_+\-]{16,}={0,2}$")) & _random(alone)
    whole = F.when(
        ~F.regexp_like(alone, F.lit(r"\s")) & (symbols | plain),
        findings(F.array(F.struct(lead.cast("int").alias("start"), alone.alias("text"))),
                 "SECRET", "random-tokens", 63)).otherwise(empty(FINDINGS))
    return join_findings(inside, whole)


def entropy(text: Column, ctx: Context) -> Column:
    found = hits(text, r"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_\-]{24,}={0,2}(?![A-Za-z0-9+/_=\-])")
    return findings(found, "SECRET", "entropy", 20,
                    keep=lambda h: F.regexp_like(h["text"], F.lit("[0-9]")) & F.regexp_like(h["text"], F.lit("[A-Za-z]"))
                    & (tx.entropy(h["text"]) >= ctx.entropy_threshold))
