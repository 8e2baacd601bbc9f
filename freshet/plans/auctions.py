"""Auction queries over the events table: every event is a bid, every user a person and the seller of one auction.

The tables are views by common table expressions, so Catalyst prunes columns and pushes filters down to the one Parquet scan.
Each query is a template for both dialects; ties are broken by event_id, so that results are the same in every run.
"""

from __future__ import annotations

BID = "bid AS (SELECT event_id, event_id % 150 AS auction, user_id AS bidder, CAST(floor(value * 100) AS BIGINT) AS price, event_type AS channel, 'https://shop.example/' || event_type || '/' || CAST(user_id AS VARCHAR(20)) || '/item' AS url, ts AS date_time FROM events)"
AUCTION = "auction AS (SELECT user_id AS id, user_id AS seller, 10 + user_id % 5 AS category, 'item ' || CAST(user_id AS VARCHAR(20)) AS item_name, min(ts) AS date_time, min(ts) + INTERVAL '12' DAY AS expires FROM events GROUP BY user_id)"
PERSON = "person AS (SELECT user_id AS id, 'person ' || CAST(user_id AS VARCHAR(20)) AS name, CASE user_id % 4 WHEN 0 THEN 'or' WHEN 1 THEN 'id' WHEN 2 THEN 'ca' ELSE 'ny' END AS state, min(ts) AS date_time FROM events GROUP BY user_id)"

#: Price bands in cents, as the bid reports count them.
LOW, HIGH = 2_000, 7_000
BANDS = (("rank1", f"price < {LOW}"), ("rank2", f"price >= {LOW} AND price < {HIGH}"), ("rank3", f"price >= {HIGH}"))


def _counts(*distinct: str) -> str:
    """COUNT(*) and COUNT(DISTINCT) of each column, in all and by price band."""
    out = []
    for what, name in [("*", "bids"), *[(f"DISTINCT {c}", f"{c}s") for c in distinct]]:
        out += [f"count({what}) AS total_{name}", *[f"count({what}) FILTER (WHERE {p}) AS {b}_{name}" for b, p in BANDS]]
    return ", ".join(out)


# {day:X}-like marks are filled for each dialect below: DAY(x) the day that x lies in, HOPS the windows of every bid.
TEMPLATES = {
    "q0": ([BID], "SELECT auction, bidder, price, channel, url, date_time FROM bid"),
    "q1": ([BID], "SELECT auction, bidder, CAST(price * 0.908 AS DECIMAL(20, 3)) AS price, channel, url, date_time FROM bid"),
    "q2": ([BID], "SELECT auction, price FROM bid WHERE auction % 123 = 0"),
    "q3": ([AUCTION, PERSON], "SELECT p.name, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 10 AND p.state IN ('or', 'id', 'ca')"),
    "q4": ([BID, AUCTION], "SELECT category, round(avg(best), 6) AS avg_final FROM (SELECT a.category, max(b.price) AS best FROM bid b JOIN auction a ON b.auction = a.id AND b.date_time BETWEEN a.date_time AND a.expires GROUP BY a.id, a.category) t GROUP BY category"),
    "q5": ([BID], "SELECT auction, starttime, num FROM (SELECT auction, starttime, num, max(num) OVER (PARTITION BY starttime) AS most FROM (SELECT auction, starttime, count(*) AS num FROM ({hops}) h GROUP BY auction, starttime) c) m WHERE num = most"),
    "q7": ([BID], "SELECT b.auction, b.price, b.bidder, b.date_time FROM bid b JOIN (SELECT max(price) AS most, {day_x} AS w FROM (SELECT price, date_time AS x FROM bid) s GROUP BY {day_x}) m ON b.price = m.most WHERE b.date_time BETWEEN m.w AND m.w + INTERVAL '1' DAY"),
    "q8": ([AUCTION, PERSON], "SELECT p.id, p.name, p.w AS starttime FROM (SELECT id, name, {day_x} AS w FROM (SELECT id, name, date_time AS x FROM person) s) p JOIN (SELECT DISTINCT seller, {day_x} AS w FROM (SELECT seller, date_time AS x FROM auction) s) a ON p.id = a.seller AND p.w = a.w"),
    "q9": ([BID, AUCTION], "SELECT a.id, a.item_name, a.category, w.bidder, w.price, w.date_time FROM auction a JOIN (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time, event_id) AS r FROM bid) w ON a.id = w.auction WHERE w.r = 1"),
    "q12": ([BID], "SELECT bidder, {day_x} AS starttime, {day_x} + INTERVAL '1' DAY AS endtime, count(*) AS bid_count FROM (SELECT bidder, date_time AS x FROM bid) s GROUP BY bidder, {day_x}"),
    "q15": ([BID], f"SELECT CAST(date_time AS DATE) AS day, {_counts('bidder', 'auction')} FROM bid GROUP BY CAST(date_time AS DATE)"),
    "q16": ([BID], f"SELECT channel, CAST(date_time AS DATE) AS day, {_counts('bidder', 'auction')} FROM bid GROUP BY channel, CAST(date_time AS DATE)"),
    "q17": ([BID], f"SELECT auction, CAST(date_time AS DATE) AS day, {_counts()}, min(price) AS min_price, max(price) AS max_price, round(avg(price), 6) AS avg_price, CAST(sum(price) AS BIGINT) AS sum_price FROM bid GROUP BY auction, CAST(date_time AS DATE)"),
    "q18": ([BID], "SELECT auction, bidder, price, channel, date_time FROM (SELECT *, row_number() OVER (PARTITION BY bidder, auction ORDER BY date_time DESC, event_id) AS r FROM bid) t WHERE r <= 1"),
    "q19": ([BID], "SELECT auction, bidder, price, channel, date_time FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, event_id) AS r FROM bid) t WHERE r <= 10"),
    "q20": ([BID, AUCTION], "SELECT b.auction, b.bidder, b.price, b.date_time AS bid_time, a.item_name, a.seller, a.expires FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 10"),
    "q22": ([BID], "SELECT auction, price, {dir_1} AS dir1, {dir_2} AS dir2, {dir_3} AS dir3 FROM bid"),
}

SPARK = {"day_x": "fx_tumble(x, 86400000000)", "hops": "SELECT auction, window(date_time, '1 day', '6 hours').start AS starttime FROM bid"} | {f"dir_{i}": f"fx_split_index(url, '/', {i + 2})" for i in (1, 2, 3)}
DUCK = {"day_x": "time_bucket(INTERVAL 1 DAY, x)", "hops": "SELECT auction, time_bucket(INTERVAL 6 HOUR, date_time) - INTERVAL (6 * k) HOUR AS starttime FROM bid, range(4) r(k)"} | {f"dir_{i}": f"string_split(url, '/')[{i + 3}]" for i in (1, 2, 3)}

PAIRS = {f"auctions_{k}": tuple(f"WITH {', '.join(views)} {sql.format(**names)}" for names in (SPARK, DUCK)) for k, (views, sql) in TEMPLATES.items()}

_ROLLING = ", ".join(f"count(*) OVER w{d} AS n_{d}d, CAST(sum(amount) OVER w{d} AS BIGINT) AS sum_{d}d" for d in (1, 7, 30))
_WINDOWS = ", ".join(f"w{d} AS (PARTITION BY cust_id ORDER BY ts RANGE BETWEEN INTERVAL '{d}' DAY PRECEDING AND CURRENT ROW)" for d in (1, 7, 30))
FRAUD = f"SELECT txn_id, cust_id, name, {_ROLLING} FROM (SELECT e.event_id AS txn_id, e.user_id AS cust_id, c.c_name AS name, CAST(floor(e.value * 100) AS BIGINT) AS amount, e.ts FROM events e JOIN customer c ON e.user_id = c.c_custkey) t WINDOW {_WINDOWS}"
PAIRS["fraud_features"] = (FRAUD, FRAUD)
