"""Addresses, hosts, registrable domains, IP ranges and URL evidence as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level names and the country codes under which they are public suffixes.
SECOND_LEVEL = {
    "com": "ar au br cn co eg hk mx my ng pe ph pk pl sa sg tr tw ua uy vn",
    "co": "at cr hu id il in jp ke kr nz th uk za",
    "org": "ar au br cn hk in mx my nz pk pl sg tr tw ua uk za",
    "net": "ar au br cn hk in mx my nz pk pl sg tr tw ua uk za",
    "gov": "ar au br cn hk in my pk pl sg tr tw ua uk za",
    "edu": "ar au br cn hk in mx my pk pl sg tr tw ua",
    "ac": "id il in jp ke kr nz th uk za",
    "go": "id jp ke kr th",
    "or": "at id jp ke kr th",
    "ne": "jp ke kr",
}
# Other public suffixes of several labels, among them names under which anyone may register hosts.
OTHER_SUFFIXES = (
    "bank.in", "nic.in", "res.in", "ltd.uk", "plc.uk", "nhs.uk", "id.au", "asn.au", "ad.jp", "gr.jp", "lg.jp", "gob.mx", "gob.ar", "govt.nz",
    "github.io", "gitlab.io", "blogspot.com", "herokuapp.com", "netlify.app", "vercel.app", "web.app", "firebaseapp.com", "pages.dev", "workers.dev",
    "azurewebsites.net", "cloudfront.net", "s3.amazonaws.com",
)
# Names whose every child is a public suffix, and the children that are not.
WILDCARDS = ("ck", "bd", "np", "kh", "mm", "er", "fk", "jm", "kawasaki.jp", "kitakyushu.jp", "kobe.jp", "nagoya.jp", "sapporo.jp", "sendai.jp", "yokohama.jp")
EXCEPTIONS = ("www.ck", "city.kawasaki.jp", "city.kitakyushu.jp", "city.kobe.jp", "city.nagoya.jp", "city.sapporo.jp", "city.sendai.jp", "city.yokohama.jp")


@dataclass(frozen=True)
class Suffixes:
    """Public-suffix rules of several labels for use inside expressions; any other last label is a suffix by itself."""
    exact: tuple[str, ...]
    wildcard: tuple[str, ...] = ()
    exception: tuple[str, ...] = ()

    def depth(self) -> int:
        """Labels of the longest suffix a rule can give."""
        labels = lambda names: max((n.count(".") + 1 for n in names), default=1)
        return max(labels(self.exact), labels(self.wildcard) + bool(self.wildcard), labels(self.exception))


#: the usual rules; a whole table is read by ``operators.suffixes``
SUFFIXES = Suffixes(
    tuple(f"{name}.{country}" for name, countries in SECOND_LEVEL.items() for country in countries.split()) + OTHER_SUFFIXES, WILDCARDS, EXCEPTIONS)

# IPv4 ranges that are not globally routable.
SPECIAL_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)

# Findings about a link that give context without adding to its score.
CONTEXT_ONLY = ("Redirect parameter", "Account-action wording", "Redirect remains within registrable domain")
REDIRECT_KEYS = "redirect|url|next|continue|return|redirect_uri"
TARGET_KEYS = "url|redirect|redirect_uri|next|continue|return|target|dest|destination"

_HOST_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
_V4 = "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def address(raw: Column) -> Column:
    """The address inside ``Name <a@b>`` or the bare value, lower-case."""
    inner = F.regexp_extract(raw, "<([^<>]*)>[^<>]*$", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(raw)))


def display_name(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(raw, "^([^<]*)<", 1), "\"", ""))


def domain(raw: Column) -> Column:
    """Domain part of an address, '' when there is none."""
    return F.regexp_replace(F.regexp_extract(address(raw), "@([^@]*)$", 1), "^\\.+|\\.+$", "")


def is_hostname(host: Column) -> Column:
    return (F.length(host) <= 253) & host.rlike(f"^{_HOST_LABEL}(\\.{_HOST_LABEL})*$")


def is_ipv4(value: Column) -> Column:
    return value.rlike(f"^{_OCTET}(\\.{_OCTET}){{3}}$")


def ipv4_number(value: Column) -> Column:
    """IPv4 as BIGINT, NULL for anything else."""
    number = F.aggregate(F.split(value, "\\."), F.lit(0).cast("long"), lambda acc, octet: acc * 256 + octet.cast("long"))
    return F.when(is_ipv4(value), number)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    number = 0
    for octet in base.split("."):
        number = number * 256 + int(octet)
    size = 1 << (32 - int(bits))
    low = number - number % size
    return low, low + size - 1


def is_public_ipv4(value: Column) -> Column:
    """Globally routable IPv4. The literal ranges stay inside the projection, so no join is needed; the one-element array
    binds the number once for all fourteen comparisons."""
    def outside(number: Column) -> Column:
        special = F.lit(False)
        for cidr in SPECIAL_V4:
            special = special | number.between(*cidr_bounds(cidr))
        return number.isNotNull() & ~special
    return F.coalesce(F.exists(F.array(ipv4_number(value)), outside), F.lit(False))


def is_public_ip(value: Column) -> Column:
    """As above plus IPv6: v4-mapped addresses follow their IPv4 part, only 2000::/3 minus documentation is global."""
    low = F.lower(value)
    mapped = F.regexp_extract(low, "^::ffff:([0-9.]+)$", 1)
    v6 = low.contains(":") & low.rlike("^[23][0-9a-f]{0,3}:") & ~low.rlike("^2001:0?db8:|^2001:0{0,4}:|^2002:")
    return F.when(mapped != "", is_public_ipv4(mapped)).when(low.contains(":"), v6).otherwise(is_public_ipv4(value))


def registrable(host: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    """Public suffix plus one label; IP addresses and bare suffixes pass through.

    The longest rule wins and an exception outranks all: membership tests in constant sets, one for each possible number of labels.
    """
    ending = lambda k: F.substring_index(host, ".", -k)
    # of k labels the name itself is a suffix, or it is any child of a wildcard's name
    sized = lambda k: (ending(k).isin(*suffixes.exact) if suffixes.exact else F.lit(False)) | (
        (ending(k - 1).isin(*suffixes.wildcard) & (labels >= k)) if suffixes.wildcard and k > 1 else F.lit(False))
    labels = F.size(F.split(host, "\\."))
    base = None
    for k in range(2, suffixes.depth() + 1) if suffixes.exception else ():
        test = ending(k).isin(*suffixes.exception)
        base = F.when(test, ending(k)) if base is None else base.when(test, ending(k))
    for k in range(suffixes.depth(), 1, -1):
        test = sized(k)
        base = F.when(test, ending(k + 1)) if base is None else base.when(test, ending(k + 1))
    base = ending(2) if base is None else base.otherwise(ending(2))
    return F.when(host.rlike(_V4) | host.contains(":") | (labels < 2), host).otherwise(base)


def first_label(host: Column) -> Column:
    return F.substring_index(registrable(host), ".", 1)


def within(host: Column, parent: Column) -> Column:
    return (host == parent) | host.endswith(F.concat(F.lit("."), parent))


def one_edit(left: Column, right: Column) -> Column:
    """One substitution, insertion, deletion or swap of neighbours."""
    n = F.length(left)
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(
            F.substring(left, F.lit(1), i - 1), F.substring(left, i + 1, F.lit(1)), F.substring(left, i, F.lit(1)),
            F.substring(left, i + 2, n)) == right,
    )
    return (left != right) & ((F.levenshtein(left, right) == 1) | ((n == F.length(right)) & (n > 1) & swap))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Host in lower case. Regex rather than ``parse_url``: a malformed host must be kept, not become NULL."""
    after_user = F.regexp_replace(url_authority(url), "^.*@", "")
    return F.lower(F.regexp_replace(after_user, ":[0-9]*$", ""))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-case, default port dropped, path at least '/'. NULL for other schemes."""
    clean = F.trim(url)
    scheme, host, authority = url_scheme(clean), url_host(clean), url_authority(clean)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    port = F.regexp_extract(authority, ":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_extract(clean, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(clean, "^[^?#]*\\?([^#]*)", 1)
    fragment = F.regexp_extract(clean, "#(.*)$", 1)
    built = F.concat(
        scheme, F.lit("://"), user, host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)),
    )
    return F.when(scheme.isin("http", "https") & (host != ""), built)


def url_digest(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def _unescape_twice(value: Column) -> Column:
    once = F.coalesce(F.try_url_decode(value), value)
    return F.coalesce(F.try_url_decode(once), once)


def url_reasons(url: Column, shown: Column) -> Column:
    """Structural findings of an http(s) link, in a fixed order."""
    scheme, host, authority = url_scheme(url), url_host(url), url_authority(url)
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    shown_host = url_host(F.regexp_extract(F.coalesce(shown, F.lit("")), "https?://[^ <>]+", 0))
    named = F.regexp_extract_all(query, F.lit(f"(?i)(?:^|&)(?:{TARGET_KEYS})=([^&]+)"), F.lit(1))
    targets = F.transform(named, lambda v: F.regexp_extract(_unescape_twice(v), "^(?:https?:)?//([^/?#]*)", 1))
    target_host = lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, "^.*@", ""), ":[0-9]*$", ""))
    leaving = F.filter(targets, lambda t: (target_host(t) != "") & (target_host(t) != host))
    same_base = lambda t: registrable(target_host(t)) == registrable(host)
    depth = F.size(F.split(host, "\\.")) - F.size(F.split(registrable(host), "\\."))

    def when(condition: Column, reason: str) -> Column:
        return F.when(condition, F.lit(reason))

    return F.array_compact(F.array(
        when(authority.contains("%"), "Percent-encoded authority obscures destination"),
        when(url.contains("\\"), "Backslash can produce inconsistent URL interpretation"),
        when(url.rlike("[\\x00-\\x1F\\x7F]"), "Control characters in URL"),
        when(host.rlike("^[0-9]+$|^0x[0-9a-f]+$"), "Numeric host representation requires review"),
        when(F.exists(leaving, same_base), "Redirect remains within registrable domain"),
        when(F.exists(leaving, lambda t: ~same_base(t)), "Redirect parameter points to another host"),
        when(F.exists(leaving, lambda t: t.contains("@")), "Redirect target contains user information"),
        when(~is_hostname(host) & ~host.contains(":"), "Malformed or invalid host encoding"),
        when(scheme == "http", "Unencrypted HTTP"),
        when(is_ipv4(host), "IP address used as host"),
        when(authority.rlike("^[^@]+@"), "User information obscures destination"),
        when(host.rlike("(^|\\.)xn--"), "Internationalized domain; review visual similarity"),
        when(depth >= 3, "Excessive subdomains"),
        when(query.rlike(f"(?i)(^|&)({REDIRECT_KEYS})=."), "Redirect parameter"),
        when(F.length(url) > 250, "Unusually long URL"),
        when((shown_host != "") & (shown_host != host), "Displayed URL differs from destination"),
        when(F.concat(host, path).rlike("(?i)verify|login|password|secure|account"), "Account-action wording"),
    ))


def url_score(url: Column, reasons: Column) -> Column:
    """20 points per scoring reason up to 100; schemes that carry content or open local handlers score by themselves."""
    scheme = url_scheme(url)
    scoring = F.filter(reasons, lambda r: ~r.isin(*CONTEXT_ONLY))
    return (
        F.when(scheme.isin("javascript", "data", "vbscript"), 100)
        .when(scheme.isin("file", "search-ms", "search") | scheme.startswith("ms-"), 60)
        .otherwise(F.least(F.lit(100), F.size(scoring) * 20))
    ).cast("int")
