"""Column functions on single cases."""
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from shopfront import dims
from shopfront.functions import contacts as C
from shopfront.functions import score as S
from shopfront.functions import urls as U
from shopfront.operators import robots as R


def identity(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return U.url_identity(df, "u").orderBy("i").collect()


def test_urls_lose_tracking_and_fragments(spark):
    (r,) = identity(spark, ["www.Example.com/?utm_source=x&fbclid=y#frag"])
    assert (r.n_url, r.n_host, r.n_dedupe_key) == ("https://www.example.com/", "example.com", "example.com")


def test_every_suffix_of_the_tables(spark):
    free = {f"https://{who}.{suffix}/page/{i}": f"{who}.{suffix}" for i, suffix in enumerate(dims.FREE_HOST_SUFFIXES) for who in ("north", "south-2")}
    two = {f"http://deep.www.brewer{i}.{suffix}/?q={i}": f"brewer{i}.{suffix}" for i, suffix in enumerate(dims.TWO_LABEL_SUFFIXES)}
    own = {"https://shop.ferry-lane.dev": "ferry-lane.dev", "https://ferry-lane.dev:8443/a/b": "ferry-lane.dev"}
    want = {**free, **two, **own}
    assert [r.n_dedupe_key for r in identity(spark, list(want))] == list(want.values())


def test_every_social_host(spark):
    # a path of one word is an account wherever accounts have one word; elsewhere a kind goes before the name
    path = {"linkedin": "school/Mill-Lane", "youtube": "user/MillLane", "whatsapp": "0031-20", "telegram": "Mill_Lane"}
    handle = {"linkedin": "school/mill-lane", "youtube": "user/milllane", "whatsapp": "003120", "telegram": "mill_lane"}
    hosts = [(h, p) for h, p in dims.SOCIAL_HOSTS.items() if p in {"facebook", "instagram", "threads", "tiktok", "twitter", *path}]
    rows = identity(spark, [f"https://de.{h}/{path.get(p, 'MillLane')}" for h, p in hosts] + [f"http://{h}/" for h, _ in hosts])
    assert [(r.n_platform, r.n_handle) for r in rows[: len(hosts)]] == [(p, handle.get(p, "milllane")) for _, p in hosts]
    assert [(r.n_platform, r.n_handle) for r in rows[len(hosts) :]] == [(p, None) for _, p in hosts]
    assert all(r.n_is_social and not r.n_is_hub for r in rows)


def test_hubs_are_no_profiles_and_posts_no_accounts(spark):
    hubs = identity(spark, [f"https://{h}/mill.lane" for h in dims.LINK_HUB_HOSTS])
    assert all(r.n_is_hub and not r.n_is_social and r.n_platform is None for r in hubs)
    posts = identity(spark, ["https://www.instagram.com/reels/C9/", "https://facebook.com/groups/77", "https://x.com/hashtag/bread", "https://linkedin.com/jobs/1", "https://youtube.com/shorts"])
    assert [r.n_handle for r in posts] == [None] * len(posts)


def test_share_widgets(spark):
    said = ["https://www.facebook.com/dialog/share?app_id=1", "https://x.com/share?text=a", "https://www.linkedin.com/sharing/share-offsite/?u=b", "https://pinterest.com/pin/create/button/"]
    assert [r.n_share for r in identity(spark, said)] == [bool(re.search("|".join(dims.SHARE_PATHS), u.split("/", 3)[3] and "/" + u.split("/", 3)[3])) for u in said]
    assert [r.n_share for r in identity(spark, ["https://ferry-lane.dev/share", "https://x.com/MillLane"])] == [False, False]


def test_unusable_urls(spark):
    bad = ["mailto:a@b.com", "tel:+441234", "javascript:void(0)", "", "not a url", "http://localhost", None, "#top"]
    assert [r.n_url for r in identity(spark, bad)] == [None] * len(bad)


def test_default_ports_and_encoding(spark):
    rows = identity(spark, ["https://a.com:443/b", "http://a.com:8080", "https://a.com/für mich?q=ü"])
    assert [r.n_url for r in rows] == ["https://a.com/b", "http://a.com:8080/", "https://a.com/f%C3%BCr%20mich?q=%C3%BC"]


def test_cache_key_is_shared_by_variants(spark):
    urls = ["https://www.Example.com/contact?utm_source=news&b=2&a=1", "https://example.com/contact?a=1&b=2#x"]
    df = U.cache_key(spark.createDataFrame([(u,) for u in urls], "u string"), "u")
    assert {r.cache_key for r in df.collect()} == {"https://example.com/contact?a=1&b=2"}


def test_names(values):
    names = [f"Zürcher {word.upper()} Ölmühle, no. {i}" for i, word in enumerate(dims.LEGAL_WORDS)] + ["  ", "Çağlar & Söhne", "GMBHaus", "łódź—ÅRHUS"]
    want = [f"zurcher olmuhle no {i}" for i in range(len(dims.LEGAL_WORDS))] + ["", "caglar sohne", "gmbhaus"]
    assert values(lambda c: U.normalize_name(F.col(c)), names)[: len(want)] == want
    assert values(lambda c: U.normalize_name(F.col(c), nfkd=True), names)[: len(want)] == want


def test_days_do_not_drift(spark):
    days = [("2026-01-31", 1, "2026-02-01"), ("2026-03-01", -1, "2026-02-28"), ("2024-02-28", 1, "2024-02-29")]
    df = spark.createDataFrame(days, "d string, n int, want string")
    assert all(r.ok for r in df.select((F.date_add(F.to_date("d"), F.col("n")).cast("string") == F.col("want")).alias("ok")).collect())
    assert spark.range(1).select(U.local_day(F.lit(dt.datetime(2026, 1, 5, 23, 59)))).first()[0] == dt.date(2026, 1, 5)


def test_emails(values):
    found = values(lambda c: C.find_emails(F.col(c)), ["Mail INFO@Shop.co.uk, or x@example.com; img@2x.png 12345@a.com jo.b@a-b.de.", "none here", "a@b"])
    assert found == [["info@shop.co.uk", "jo.b@a-b.de"], [], []]
    assert values(lambda c: C.email_kind(F.col(c)), ["info@a.de", "sales.uk@a.de", "no-reply@a.de", "jane@a.de"]) == ["role", "role", "noreply", "personal"]


def test_email_scan_is_linear_in_long_runs(values):
    run = "a" * 200_000
    assert values(lambda c: C.find_emails(F.col(c)), [run + " @ x " + run + "_b@c.de.x@y.de"]) == [[]]
    assert values(lambda c: C.find_emails(F.col(c)), ["a_b@c.de_x@y.de"]) == [["a_b@c.de", "_x@y.de"]]


def test_spelled_out_addresses(values):
    texts = ["jo (at) firm (dot) de", "jo [at] firm.co dot uk now", "a&#64;b&#46;com", "nothing"]
    assert [t.split() for t in values(lambda c: C.deobfuscate(F.col(c)), texts)] == [["jo@firm.de"], ["jo@firm.co.uk", "now"], ["a@b.com"], ["nothing"]]


def test_protected_addresses(values):
    hidden = lambda text, key: f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text)
    cases = [hidden("hi@salon.co", 0x42), "zz", "42", hidden("no at sign", 7), "4242" + hidden("x@y.z", 0x42)[2:]]
    assert values(lambda c: C.decode_protected(F.col(c)), cases) == ["hi@salon.co", None, None, None, None]


def test_phones(spark):
    cases = [("+44 1373 123456", None, "+441373123456", None), ("020 7946 0999", "gb", "+442079460999", None), ("0049 30 1234567", None, "+49301234567", None),
             ("555-0100", None, None, "country_unknown"), ("12345", "gb", None, "too_few_digits"), ("(212) 555-0100", "us", "+12125550100", None),
             ("+999 12345678", None, None, "unparseable"), ("tel:+33 1 23 45 67 89", None, "+33123456789", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, raw string, country string, want string, why string")
    for r in C.add_phone(df, "raw", "country").collect():
        assert (r.p.e164, r.p.reject_reason) == (r.want, r.why), r.raw


def test_human_numbers(values):
    cases = {"1,234": 1234, "1.234": 1234, "1 234": 1234, "1.2K": 1200, "3.4M": 3400000, "12K subscribers": 12000, "2 billion": 2000000000,
             "1,234.5": None, "none": None, "7 members": 7000000}
    assert values(lambda c: C.human_number(F.col(c)), list(cases)) == list(cases.values())


def test_followers(spark):
    wall = "please log in"
    cases = [("youtube", '"subscriberCountText":{"simpleText":"1.2K subscribers"} "videoId"', (1200, "known", None, True)),
             ("youtube", 'itemprop="interactionCount" content="77"', (77, "known", None, False)), ("youtube", wall, (None, "blocked", "blocked_by_waf", False)),
             ("tiktok", '"followerCount":55,"videoCount": 2', (55, "known", None, True)), ("tiktok", "captcha", (None, "blocked", "blocked_by_waf", False)),
             ("tiktok", wall + " " * 31000, (None, "unknown", "no_count_in_markup", False)), ("facebook", wall, (None, "blocked", "platform_requires_auth", False)),
             ("facebook", '<meta name="description" content="12,345 likes">', (12345, "known", None, False)),
             ("instagram", wall + " " * 99000 + '"is_video":true', (None, "blocked", "platform_requires_auth", True)),
             ("instagram", '"edge_followed_by":{"count":9}', (9, "known", None, False)), ("linkedin", "x", (None, "unsupported", "platform_tos_blocked", False))]
    df = spark.createDataFrame([(i, p, h) for i, (p, h, _) in enumerate(cases)], "i int, platform string, html string")
    got = [tuple(r.f) for r in C.add_followers(df, "platform", "html").orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_tiers(spark):
    df = spark.createDataFrame([(499,), (500,), (1999,), (2000,), (9999,), (10000,), (None,)], "n int")
    got = [r[0] for r in df.select(S.magnitude_tier(F.col("n"))).collect()]
    assert got == ["under500", "under2k", "under2k", "under10k", "under10k", "atLeast10k", "unknown"]


TOKEN = "shopfrontbot"


def decide(spark, text, path):
    files = spark.createDataFrame([("d", text)], "domain string, body string")
    urls = spark.createDataFrame([("d", path)], "domain string, path string")
    return R.robots_decision(urls, R.robots_rules(files), TOKEN).first()


def plain_decision(groups, path):
    """(agents, [(allow, pattern)], delay) groups in order: the longest named group that fits, else *; its longest fitting rule, allow before disallow."""
    fits = [(0 if a == "*" else len(a)) for agents, _, _ in groups for a in agents if a == "*" or a.lower() in TOKEN or TOKEN in a.lower()]
    best = max(fits, default=None)
    chosen = [g for g in groups if any((0 if a == "*" else len(a)) == best and (a == "*" or a.lower() in TOKEN or TOKEN in a.lower()) for a in g[0])]
    hits = []
    for _, rules, _ in chosen:
        for allow, pattern in rules:
            body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
            if pattern and re.match(".*".join(map(re.escape, body.split("*"))) + end, path or "/", re.S):
                hits.append((len(re.sub("[*$]", "", pattern)), allow))
    return max(hits)[1] if hits else True


def test_robots_like_a_plain_reader(spark):
    rng = random.Random(12)
    parts = ["/", "/menu", "/menu/lunch", "/*.html", "/*.html$", "/a*z", "/menu*", "", "/$"]
    paths = ["", "/", "/menu", "/menu/lunch/1", "/x.html", "/x.html?p", "/abcz", "/menu.html", "/other"]
    files, urls, want = [], [], {}
    for i in range(60):
        groups = [(rng.sample(["*", "frontbot", "shopfrontbot", "elsebot", "SHOP"], rng.choice([1, 1, 2])), [(rng.random() < 0.5, rng.choice(parts)) for _ in range(rng.randrange(4))], None) for _ in range(rng.randrange(4))]
        # a group without rules runs into the next, so each has one at least
        groups = [(a, r or [(False, "")], d) for a, r, d in groups]
        lines = [line for a, r, _ in groups for line in [*(f"{rng.choice(['User-agent', 'user-AGENT'])}: {x}  # who" for x in a), *(f"{'Allow' if y else 'Disallow'}:{p}" for y, p in r), ""]]
        files.append((f"d{i}", rng.choice(["\n", "\r\n"]).join(lines)))
        for k, path in enumerate(paths):
            urls.append((100 * i + k, f"d{i}", path))
            want[100 * i + k] = plain_decision(groups, path)
    rules = R.robots_rules(spark.createDataFrame(files, "domain string, body string"))
    got = R.robots_decision(spark.createDataFrame(urls, "id int, domain string, path string"), rules, TOKEN)
    assert {r.id: r.allowed for r in got.collect()} == want
    assert decide(spark, "User-agent: *\nCrawl-delay: 0.75\nDisallow: /q", "/r").delay_ms == 750


def test_sitemaps(spark, values):
    files = spark.createDataFrame([("d", "user-agent: *\nAllow: /\nSITEMAP:   https://maps.test/index-2.xml # all")], "domain string, body string")
    assert [r.value for r in R.robots_rules(files).filter("kind = 'sitemap'").collect()] == ["https://maps.test/index-2.xml"]
    xml = "<urlset><url><loc>https://a.test/contact</loc></url>\n<url><loc>https://a.test/about?a=1&amp;b=2</loc></url></urlset>"
    assert values(lambda c: R.sitemap_urls(F.col(c)), [xml]) == [["https://a.test/contact", "https://a.test/about?a=1&b=2"]]


def test_reference_tables(spark):
    for name, (_, rows) in dims.tables().items():
        assert dims.dim(spark, name).count() == len(rows)
    assert {s for p in dims.PRESET_POINTS for s in dims.SITE_POINTS} == set(dims.SITE_STATES)


def test_character_references_of_any_code_point(values):
    from shopfront.functions import html as H

    texts = ["&#105;&#110;&#102;&#111;&#64;firm.test", "hi&#x40;firm2.test &amp;c", "&#x20AC; &#128578; &#0; &#xD800;", "none", None]
    assert values(lambda c: H.decode_entities(F.col(c)), texts) == ["info@firm.test", "hi@firm2.test &c", "€ 🙂 � �", "none", None]


def test_json_escapes_are_read(values):
    from shopfront.functions import html as H

    assert values(lambda c: H.json_unescape(F.col(c)), [r"info@firm.test", r"café", r"a\nb\"c\\", "plain"]) == ["info@firm.test", "café", 'a\nb"c\\', "plain"]


def test_only_the_attribute_itself_counts(values):
    from shopfront.functions import html as H

    page = """<a data-href="/no" class=x href='/yes'>t</a><a data-href="/no">t</a><a
 href=/also>u</a>"""
    assert values(lambda c: H.hrefs(F.col(c)), [page]) == [["/yes", "/also"]]


def test_nothing_is_cut_by_length(values):
    from shopfront.functions import html as H
    from shopfront.functions import site as T
    from shopfront.operators import robots as R

    title = "word " * 200
    assert values(lambda c: T.site_title(F.col(c)), [f"<title>{title}</title>"]) == [title.strip()]
    text = "long " * 40 + "contact"
    assert [a.text for a in values(lambda c: H.anchors(F.col(c)), [f"<a href=/x>{text}</a>"])[0]] == [text]
    many = "".join(f"<loc>https://a.test/{i}</loc>" for i in range(300))
    assert len(values(lambda c: R.sitemap_urls(F.col(c)), [many])[0]) == 300


def test_dot_segments_are_resolved(values, spark):
    paths = ["/x/../contact", "/./contact", "/a/b/../../c", "/../x", "/a/..", "/a/.", "/a/./", "/a..b/.c", "/", ""]
    assert values(lambda c: U.resolve_dots(F.col(c)), paths) == ["/contact", "/contact", "/c", "/x", "/", "/a/", "/a/", "/a..b/.c", "/", ""]
    urls = spark.createDataFrame([("https://a.test/x/../contact",), ("https://a.test/./contact",), ("https://www.a.test/contact?utm_source=q",)], "url string")
    assert {r.cache_key for r in U.cache_key(urls, "url").collect()} == {"https://a.test/contact"}
