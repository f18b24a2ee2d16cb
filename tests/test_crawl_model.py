"""The set-based crawl plans against a sequential model of the original
page loop, on random sites, pages, states and stored URLs."""

import random

from pyspark.sql import functions as F

from almanac.operators.crawl import keyword_search_plan, listing_scan_plan

STATE = "subdomain string, search_keyword string, page_number int, last_processed_url string, status string"


def model_listing(pages, state, existing, max_pages, threshold):
    """pages: {page: [links]}; state: (page, url, status) or None."""
    st = list(state) if state else [None, None, "running"]
    if state and st[2] in ("completed", "pagination_blocked"):
        return [], [], tuple(st)
    start = st[0] if (state and st[2] == "running" and st[0]) else 1
    counts, visited, work, dups = {}, set(), [], []
    orig = tuple(st)
    for page in range(start, max_pages + 1):
        links = pages.get(page, [])
        stop, reason, urls = False, None, []
        if not links:
            stop, reason = True, "no_links"
        elif tuple(links) in counts:
            counts[tuple(links)] += 1
            stop, reason = counts[tuple(links)] >= threshold, "repeated_page"
        else:
            counts[tuple(links)] = 0
            urls = list(links)
        if state and orig[2] == "running" and orig[0] is not None and orig[1] and urls:
            if page < orig[0]:
                urls = []
            elif page == orig[0] and orig[1] in urls:
                urls = urls[urls.index(orig[1]) + 1:]
        for u in urls:
            if u in visited:
                continue
            visited.add(u)
            (dups if u in existing else work).append((page, u))
            st[0], st[1] = page, u
        if stop:
            st[0] = page
            st[2] = {"repeated_page": "pagination_blocked"}.get(reason, "completed")
            break
    return work, dups, tuple(st)


def test_listing_plan_matches_model(spark):
    rnd = random.Random(11)
    pool = [f"u{i}" for i in range(12)]
    rows, states, existing, expected = [], [], set(rnd.sample(pool, 3)), {}
    for s in range(60):
        site = f"s{s}"
        n_pages = rnd.randint(1, 6)
        shapes = [sorted(rnd.sample(pool, rnd.randint(0, 3))) for _ in range(3)]
        pages = {p: list(dict.fromkeys(rnd.choice(shapes) if rnd.random() < 0.7 else rnd.sample(pool, 2)))
                 for p in range(1, n_pages + 1)}
        pages[n_pages + 1] = []  # the fetcher records the empty page after the last one
        state = None
        r = rnd.random()
        if r < 0.2:
            state = (rnd.randint(1, n_pages), rnd.choice(pool), "running")
        elif r < 0.3:
            state = (1, None, rnd.choice(["completed", "pagination_blocked"]))
        rows += [(site, p, l) for p, l in pages.items()]
        if state:
            states.append((site, "__listing__", state[0], state[1], state[2]))
        expected[site] = model_listing(pages, state, existing, 5, 2)
    p = spark.createDataFrame(rows, "site string, page int, links array<string>")
    st = spark.createDataFrame(states, STATE)
    ex = spark.createDataFrame([(u,) for u in existing], "url string")
    work, dups, end = listing_scan_plan(p, st, ex, max_pages=5, threshold=2)
    got_w = {}
    for r in work.collect():
        got_w.setdefault(r["site"], []).append((r["page"], r["pos"], r["url"]))
    got_d = {}
    for r in dups.collect():
        got_d.setdefault(r["site"], []).append((r["page"], r["pos"], r["url"]))
    got_s = {r["site"]: (r["page_number"], r["last_processed_url"], r["status"]) for r in end.collect()}
    for site, (w, d, s) in expected.items():
        assert [(pg, u) for pg, _, u in sorted(got_w.get(site, []))] == w, site
        assert [(pg, u) for pg, _, u in sorted(got_d.get(site, []))] == d, site
        if s != (None, None, "running"):
            assert got_s.get(site) == s, (site, got_s.get(site), s)


def model_search(pages, states, existing, keywords, max_pages, dates=None, as_of=None):
    """pages: {(kw, page): [links]}; states: {kw: (page, url, status)};
    with ``dates`` ({url: date or None}) the current-month rules apply."""
    cur = lambda d: d is not None and as_of is not None and (d.year, d.month) == (as_of.year, as_of.month)
    active = [k for k in keywords if not (states.get(k) and states[k][2] == "completed")]
    st = {k: list(states[k]) if k in states else [None, None, "running"] for k in keywords}
    orig = {k: tuple(v) for k, v in st.items()}
    running = [orig[k][0] for k in active if k in states and orig[k][2] == "running" and orig[k][0]]
    start = min(running) if running else 1
    seen_sig = {k: set() for k in keywords}
    visited, out = set(), []
    for page in range(start, max_pages + 1):
        if not active:
            break
        sources, to_stop = {}, set()
        for k in list(active):
            if k in states and orig[k][2] == "running" and orig[k][0] is not None and page < orig[k][0]:
                continue
            links = pages.get((k, page), [])
            if not links:
                urls, stop = [], True
            elif tuple(links) in seen_sig[k]:
                urls, stop = [], True
            else:
                seen_sig[k].add(tuple(links))
                urls, stop = list(links), False
                if dates is not None:
                    if page == 1 and not cur(dates.get(links[0])):
                        urls, stop = [], True
                    else:
                        data = [u for u in links if u not in visited and dates.get(u) is not None]
                        data.sort(key=lambda u: -dates[u].toordinal())
                        urls = []
                        for u in data:
                            if not cur(dates[u]):
                                stop = True
                                break
                            urls.append(u)
                        if not urls:
                            stop = True
            o = orig[k]
            if k in states and o[2] == "running" and o[0] is not None and o[1]:
                if page < o[0]:
                    urls = []
                elif page == o[0] and o[1] in urls:
                    urls = urls[urls.index(o[1]) + 1:]
            for u in urls:
                sources.setdefault(u, set()).add(k)
            if stop:
                to_stop.add(k)
        for u, ks in sources.items():
            if u in visited:
                continue
            visited.add(u)
            out.append((u, page, tuple(sorted(ks)), u in existing))
        for k in to_stop:
            st[k][0], st[k][2] = page, "completed"
            active.remove(k)
    return sorted(out), {k: (v[0], v[2]) for k, v in st.items()}


def test_search_plan_matches_model(spark):
    rnd = random.Random(5)
    pool = [f"v{i}" for i in range(10)]
    kws = ["A", "B", "C"]
    rows, states, existing, expected = [], [], set(rnd.sample(pool, 2)), {}
    for s in range(50):
        site = f"s{s}"
        pages, sstates = {}, {}
        for k in kws:
            n = rnd.randint(1, 4)
            for p in range(1, n + 1):
                pages[(k, p)] = list(dict.fromkeys(rnd.sample(pool, rnd.randint(0, 3))))
            pages[(k, n + 1)] = []  # the empty page after the last one
            r = rnd.random()
            if r < 0.15:
                sstates[k] = (1, None, "completed")
            elif r < 0.3:
                sstates[k] = (rnd.randint(1, 2), rnd.choice(pool), "running")
        rows += [(site, k, p, l) for (k, p), l in pages.items()]
        states += [(site, k, v[0], v[1], v[2]) for k, v in sstates.items()]
        expected[site] = model_search(pages, sstates, existing, kws, 4)
    p = spark.createDataFrame(rows, "site string, keyword string, page int, links array<string>")
    st = spark.createDataFrame(states, STATE)
    ex = spark.createDataFrame([(u,) for u in existing], "url string")
    work, dups, end = keyword_search_plan(p, st, ex, max_pages=4)
    got = {}
    for r in work.withColumn("dup", F.lit(False)).unionByName(dups.withColumn("dup", F.lit(True))).collect():
        got.setdefault(r["site"], []).append((r["url"], r["page"], tuple(r["keywords"]), r["dup"]))
    ends = {(r["site"], r["keyword"]): (r["page_number"], r["status"]) for r in end.collect()}
    for site, (out, sts) in expected.items():
        assert sorted(got.get(site, [])) == out, site
        for k, (pg, status) in sts.items():
            if status == "completed":
                assert ends.get((site, k), (None, None))[1] == "completed", (site, k)


def model_stale(pages, as_of):
    """pages: {page: [(pos, date or None)]}; yields kept (page, pos)."""
    kept = []
    for page in sorted(pages):
        rows = pages[page]
        cur = lambda d: d is not None and (d.year, d.month) == (as_of.year, as_of.month)
        if page == 1 and not cur(min(rows)[1]):
            break
        dated = sorted([r for r in rows if r[1] is not None], key=lambda r: (-r[1].toordinal(), r[0]))
        out, stop = [], False
        for pos, d in dated:
            if not cur(d):
                stop = True
                break
            out.append((page, pos))
        kept += out
        if stop or not out:
            break
    return kept


def test_stale_cut_matches_model(spark):
    import datetime as dt
    from almanac.operators.frontier import stale_cut
    rnd = random.Random(3)
    as_of = dt.date(2026, 6, 15)
    days = [dt.date(2026, 6, d) for d in (1, 5, 9, 20, 28)] + [dt.date(2026, 5, 30), dt.date(2026, 7, 2), None]
    rows, expected = [], {}
    for k in range(150):
        pages = {}
        for page in range(1, rnd.randint(1, 4) + 1):
            pages[page] = [(pos, rnd.choice(days) if rnd.random() < 0.9 else None) for pos in range(rnd.randint(1, 5))]
        rows += [(f"k{k}", page, pos, d) for page, rs in pages.items() for pos, d in rs]
        expected[f"k{k}"] = model_stale(pages, as_of)
    df = spark.createDataFrame(rows, "k string, page int, pos int, d date").withColumn("ts", F.col("d").cast("timestamp"))
    got = {}
    for r in stale_cut(df, ["k"], "page", "pos", "ts", "2026-06-15").collect():
        got.setdefault(r["k"], []).append((r["page"], r["pos"]))
    for k, want in expected.items():
        assert sorted(got.get(k, [])) == sorted(want), k


def test_search_plan_month_mode_matches_model(spark):
    import datetime as dt
    rnd = random.Random(17)
    pool = [f"w{i}" for i in range(12)]
    choices = [dt.date(2026, 6, d) for d in (2, 9, 16, 23)] + [dt.date(2026, 5, 20), dt.date(2026, 7, 1), None]
    dates = {u: rnd.choice(choices) for u in pool}
    dates.update({u: dt.date(2026, 6, 11) for u in rnd.sample(pool, 4)})
    kws = ["A", "B"]
    rows, states, expected = [], [], {}
    for s in range(60):
        site = f"s{s}"
        pages, sstates = {}, {}
        for k in kws:
            n = rnd.randint(1, 3)
            for p in range(1, n + 1):
                pages[(k, p)] = list(dict.fromkeys(rnd.sample(pool, rnd.randint(1, 4))))
            pages[(k, n + 1)] = []
            if rnd.random() < 0.2:
                sstates[k] = (rnd.randint(1, 2), rnd.choice(pool), "running")
        rows += [(site, k, p, l) for (k, p), l in pages.items()]
        states += [(site, k, v[0], v[1], v[2]) for k, v in sstates.items()]
        expected[site] = model_search(pages, sstates, set(), kws, 4, dates, dt.date(2026, 6, 15))
    p = spark.createDataFrame(rows, "site string, keyword string, page int, links array<string>")
    st = spark.createDataFrame(states, STATE)
    ex = spark.createDataFrame([], "url string")
    ud = spark.createDataFrame([(u, d) for u, d in dates.items()], "url string, d date") \
        .select("url", F.col("d").cast("timestamp").alias("publication_date"))
    assert sum(len(v[0]) for v in expected.values()) > 40  # the fixture yields real work
    work, dups, end = keyword_search_plan(p, st, ex, max_pages=4, url_dates=ud, as_of="2026-06-15")
    got = {}
    for r in work.collect():
        got.setdefault(r["site"], []).append((r["url"], r["page"], tuple(r["keywords"]), False))
    ends = {(r["site"], r["keyword"]): (r["page_number"], r["status"]) for r in end.collect()}
    for site, (out, sts) in expected.items():
        assert sorted(got.get(site, [])) == out, site
        for k, (pg, status) in sts.items():
            if status == "completed":
                assert ends.get((site, k)) == (pg, "completed"), (site, k, ends.get((site, k)), pg)
