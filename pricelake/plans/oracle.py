"""The derived tables in SQL, as a prefix of every query's SQL."""

R2 = "floor(({}) * 100 + 0.5) / 100.0"


def r2(x: str) -> str:
    """Two decimals, halves toward positive infinity."""
    return R2.format(x)


VIEWS = f"""
WITH products AS (
  SELECT p_partkey AS id, 'SKU-' || p_partkey AS internal_sku, p_brand AS brand, p_name AS product_name,
         CASE WHEN p_partkey % 5 != 0 THEN CAST(p_partkey + 7600000000000 AS VARCHAR) END AS ean_mpn, 'GBP' AS currency, p_type AS category, p_size,
         CASE WHEN p_partkey % 17 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS delisted_at,
         CASE WHEN p_partkey % 23 = 0 THEN 'manual' ELSE 'feed' END AS source, TIMESTAMP '2023-06-01 00:00:00' AS updated_at
  FROM part),
competitors AS (
  SELECT s_suppkey AS id, 'shop-' || s_suppkey AS slug, s_name AS display_name, 'https://x.co' AS base_url, s_acctbal >= 0 AS enabled,
         CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'BRAND#' || (s_suppkey % 25 + 1) END AS only_brand
  FROM supplier),
fascias AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS VARCHAR) AS code, r_name AS name, r_regionkey != 4 AS enabled FROM region),
fascia_prices AS (
  SELECT p_partkey AS product_id, CAST(r_regionkey AS BIGINT) AS fascia_id, {r2("p_retailprice * (1 + CAST(r_regionkey AS DOUBLE) / 100.0)")} AS price,
         'GBP' AS currency, CAST(CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 2 END AS BIGINT) AS feed_import_id
  FROM part, region WHERE (p_partkey + r_regionkey) % 4 != 0),
observations AS (
  SELECT *, {r2("price * (1 + d)")} AS was_price FROM (
    SELECT l_partkey AS product_id, l_suppkey AS competitor_id, l_orderkey AS run_id, l_linenumber AS line, {r2("l_extendedprice / l_quantity")} AS price,
           l_discount AS d, l_discount > 0.05 AS promo, CASE l_returnflag WHEN 'N' THEN true WHEN 'R' THEN false END AS in_stock, l_shipdate AS observed_at
    FROM lineitem)),
matches AS (
  SELECT product_id * 100000 + competitor_id AS id, *, 'https://x.co/' || product_id || '/' || competitor_id AS url,
         CAST((product_id * 7 + competitor_id * 13) % 101 AS INTEGER) AS confidence, 'brand_spec_attributes' AS tier,
         CASE (product_id + competitor_id) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'pending' ELSE 'rejected' END AS status,
         CASE (product_id + competitor_id) % 6 WHEN 0 THEN 'auto' WHEN 3 THEN 'kim' END AS confirmed_by
  FROM (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS competitor_id FROM lineitem)),
runs AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS started_at,
         CASE WHEN o_orderkey % 3 != 0 THEN o_orderkey % 100 + 1 END AS competitor_id, CASE WHEN o_orderkey % 4 != 0 THEN o_orderkey % 200 + 1 END AS product_id FROM orders),
items AS (
  SELECT event_id AS id, user_id AS run_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status, ts AS created_at,
         CASE WHEN event_id % 5 != 0 THEN event_id % 200 + 1 END AS product_id, event_id % 100 + 1 AS competitor_id FROM events),
urls AS (
  SELECT competitor_id, url, trim(regexp_replace(lower(substr(url, 13)), '[^a-z0-9]+', ' ', 'g')) AS slug FROM (
    SELECT p_partkey % 100 AS competitor_id, 'https://x.co/' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-'
           || regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') || '/p/' || p_partkey AS url FROM part)),
latest AS (
  SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY observed_at DESC, run_id DESC, line DESC) = 1),
priced AS (
  SELECT p.*, f.price AS our_price FROM products p LEFT JOIN fascia_prices f ON f.product_id = p.id AND f.fascia_id = 1 WHERE p.delisted_at IS NULL),
seen AS (
  SELECT l.*, c.display_name AS competitor_name, p.our_price,
         CASE WHEN abs(our_price - price) < 0.005 THEN 'equal' WHEN our_price < price THEN 'lower' WHEN our_price >= price THEN 'higher' END AS position,
         {r2("our_price - price")} AS delta_abs, CASE WHEN price != 0 THEN {r2("(our_price - price) / nullif(price, 0) * 100")} END AS delta_pct,
         price IS NOT NULL AND in_stock IS DISTINCT FROM false AS purchasable
  FROM latest l JOIN priced p ON p.id = l.product_id JOIN competitors c ON c.id = l.competitor_id),
cheapest AS (SELECT * FROM seen WHERE purchasable QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, competitor_id) = 1),
compared AS (
  SELECT p.id, p.internal_sku, p.brand, p.product_name, p.category, p.currency, p.ean_mpn, p.our_price, p.our_price IS NULL AS our_price_missing, c.price AS best_price,
         c.competitor_id AS best_competitor_id, c.competitor_name AS best_competitor, c.position, c.delta_abs, c.delta_pct, c.observed_at
  FROM priced p LEFT JOIN cheapest c ON c.product_id = p.id)
"""
