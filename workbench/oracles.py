"""The same results in SQL, over the same tables. One entry per check query."""

from __future__ import annotations

from segtide.operators.nodes import OUTPUT_KINDS, SUPPORT
from workbench.tables import MARKER, POSTFIX, PREFIX, ROUTES, TYPES

NOW = "TIMESTAMP '2024-01-16 00:00:00'"
H = 3_600_000_000  # one hour in microseconds


def _values(rows, names: str) -> str:
    def text(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


def _bucket(kind: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {kind} = '{k}' THEN CASE WHEN bucket_type IS NULL THEN '' WHEN bucket_type = 'prod' THEN '{b.prod}' "
        f"WHEN bucket_type = 'custom' THEN '{b.custom}' ELSE '{b.dev}' END" for k, b in ROUTES.items()) + " ELSE '' END"


def _schedule(source: str, step: str, cols: str) -> str:
    """Half-open steps of every row of ``source`` (start_ts, end_ts)."""
    return (f"SELECT {cols}, g AS seg_start, least(g + {step}, end_ts) AS seg_end FROM (SELECT *, "
            f"unnest(generate_series(start_ts, end_ts - INTERVAL 1 MICROSECOND, {step})) AS g FROM {source}) s")


def _slot(ts: str, width: int) -> str:
    return f"(epoch_us({ts}) // {width}) * {width}"


CTES = {
    "samples": "SELECT user_id % 8 AS node, ts, event_id, value FROM events",
    "device_samples": "SELECT user_id AS node, ts, event_id, value FROM events",
    "catalog": f"""SELECT user_id % 8 AS node, ts AS file_time, 'archive/' || strftime(ts, '%Y/%m/%d') AS url,
        '{PREFIX}' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '{POSTFIX}' AS filepath,
        (600 * (1 + event_id % 5))::DOUBLE AS duration_s, event_id FROM events""",
    "listing": f"""SELECT page_id, url, unnest(list_filter(regexp_extract_all(
        regexp_replace(html, '(?s)<!--.*?-->', '<!>', 'g'), '>([^<]*)<', 1), lambda x: contains(x, '{MARKER}'))) AS node_text
        FROM pages""",
    "names": """SELECT node, url, filepath, duration_s FROM catalog
        UNION ALL SELECT NULL, url, node_text, NULL FROM listing""",
    "stripped": f"""SELECT *, replace(replace(filepath, '{PREFIX}', ''), '{POSTFIX}', '') AS stamp FROM names""",
    "timed": r"""SELECT *, CASE WHEN regexp_full_match(stamp, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?')
        THEN try_cast(stamp AS TIMESTAMP) END AS file_time FROM stripped""",
    "done": "SELECT filepath FROM catalog WHERE event_id % 3 = 0",
    "runs": """SELECT user_id % 8 AS node, ts AS started_at, epoch_us(ts) // 1000000 AS run_id, ts AS written_at
        FROM events WHERE event_type = 'signup'""",
    "device_runs": "SELECT user_id AS node, ts AS started_at FROM events WHERE event_type = 'signup'",
    "requests": """SELECT event_id, user_id % 8 AS node, ts AS now_ts, to_hours(24 * (1 + event_id % 3)) AS delay
        FROM events WHERE event_type = 'signup'""",
    "ranges": """SELECT event_id, user_id % 8 AS node, ts AS start_ts,
        ts + to_hours(1 + event_id % 8) + INTERVAL 7 MINUTE AS end_ts FROM events WHERE event_type = 'signup'""",
    "ticks": """SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30',
        INTERVAL 150 SECOND)) AS tick""",
    "january": """SELECT node, TIMESTAMP '2024-01-01' AS start_ts, TIMESTAMP '2024-02-01' AS end_ts
        FROM (SELECT DISTINCT node FROM samples) n""",
    "scheduled": _schedule("january", "INTERVAL 1 HOUR", "node"),
    "segments": f"""SELECT *, strftime(seg_start, '%Y-%m-%d') AS subdir,
        '{PREFIX}' || strftime(seg_start, '%Y-%m-%dT%H-%M-%S-%g') || '.ts' AS ts_name FROM scheduled""",
    "file_events": """SELECT event_id, user_id % 8 AS node,
        [CASE event_type WHEN 'click' THEN 'IN_CLOSE_WRITE' WHEN 'signup' THEN 'IN_MOVED_TO' ELSE 'IN_CREATE' END, 'X'] AS types,
        '/tmp/node' || (user_id % 8) || '/hls/' || (epoch_us(ts) // 86400000000) AS path,
        'live' || event_id || CASE WHEN event_id % 10 = 0 THEN '.m3u8.tmp' ELSE '.ts' END AS filename, 'hls' AS kind,
        CASE user_id % 8 % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'custom' WHEN 2 THEN 'dev' END AS bucket_type FROM events""",
    "finished": """SELECT * FROM file_events WHERE (types[1] = 'IN_CLOSE_WRITE' AND NOT contains(filename, 'tmp'))
        OR types[1] = 'IN_MOVED_TO'""",
    "objects": f"""SELECT *, {_bucket('kind')} AS bucket, path || '/' || filename AS below FROM (
        SELECT min(event_id) AS event_id, user_id % 8 AS node, 'hls' AS kind, 'node' || (user_id % 8) || '/hls/' || (epoch_us(ts) // 86400000000) AS path,
        'live' || min(event_id) || CASE WHEN min(event_id) % 10 = 0 THEN '.m3u8.tmp' ELSE '.ts' END AS filename, event_type,
        CASE user_id % 8 % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'custom' WHEN 2 THEN 'dev' END AS bucket_type,
        string_agg(event_id || ',' || epoch_us(ts), chr(10) ORDER BY event_id) AS content
        FROM events GROUP BY user_id % 8, epoch_us(ts) // 86400000000, event_type) f""",
    "node_config": f"""SELECT s_suppkey AS node, s_name AS node_name,
        {list(TYPES)}[(s_suppkey % 5 + 1)::INT] AS node_type,
        CASE WHEN s_suppkey % 2 = 0 THEN 'arm32v7' ELSE 'amd64' END AS node_arch,
        CASE WHEN s_nationkey % 7 <> 0 THEN 48000 + 48000 * (s_suppkey % 4) END AS sample_rate,
        CASE WHEN s_nationkey % 11 <> 0 THEN 1 + s_suppkey % 2 END AS channels,
        CASE s_suppkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'custom' WHEN 2 THEN 'dev' END AS bucket_type,
        'card0' AS audio_hw_id, 48000::BIGINT AS stream_rate, (1800 + 1800 * (s_suppkey % 3))::INT AS segment_duration,
        CASE WHEN s_suppkey % 3 <> 0 THEN (10800 * (1 + s_suppkey % 2))::INT END AS flac_duration FROM supplier""",
    "frames": """SELECT vec_id AS seg_id, embedding AS samples, embedding[1:32] AS ch1, embedding[33:64] AS ch2
        FROM embeddings""",
    "items": """SELECT node AS list_id, row_number() OVER (PARTITION BY node ORDER BY file_time, event_id) AS pos,
        filepath AS file, duration_s FROM catalog""",
    "tied": """SELECT s.*, epoch_us(r.started_at) AS run_us, epoch_us(r.started_at) // 1000000 AS run_id
        FROM samples s ASOF LEFT JOIN runs r ON s.node = r.node AND s.ts >= r.started_at""",
    "playing": """SELECT tick, node, filepath, file_time FROM catalog, ticks
        WHERE file_time + INTERVAL 24 HOUR < tick
          AND tick <= file_time + INTERVAL 24 HOUR + to_seconds(duration_s::BIGINT)""",
    "gaps": """SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us, lead(ts) OVER w AS next_ts FROM samples
        WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)""",
    "marked": f"""SELECT *, sum(CASE WHEN gap_us <= {H // 2} THEN 0 ELSE 1 END)
        OVER (PARTITION BY node ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM gaps""",
    "islands": """SELECT node, island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_packets
        FROM marked GROUP BY node, island""",
    "wide_marked": f"""SELECT *, sum(CASE WHEN gap_us <= {H} THEN 0 ELSE 1 END)
        OVER (PARTITION BY node ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM gaps""",
    # watermark after all rows: newest time in whole milliseconds less an hour
    "mark": f"SELECT (epoch_us(max(ts)) // 1000) * 1000 - {H} AS mark_us FROM events",
    "named_playlist": """SELECT node, subdir, '#EXTM3U' || chr(10) || '#EXT-X-TARGETDURATION:' ||
        ceil(max(len_s))::BIGINT || chr(10) || string_agg(printf('#EXTINF:%.6f,', len_s) || chr(10) || ts_name, chr(10)
        ORDER BY seg_start, ts_name) || chr(10) || '#EXT-X-ENDLIST' AS body
        FROM (SELECT *, (epoch_us(seg_end) - epoch_us(seg_start)) / 1000000 AS len_s FROM to_list) s GROUP BY node, subdir""",
    "near_back": f"""SELECT node, seg_start, max(seg_end) AS seg_end,
        CASE WHEN min(rank) = 0 THEN 'near' ELSE 'backfill' END AS origin FROM (
          {_schedule("near_ranges", "INTERVAL 1 HOUR", "node, rank")}) a GROUP BY node, seg_start""",
    "near_ranges": f"""SELECT node, rank, make_timestamp({_slot("now_ts - span", H)}) AS start_ts, now_ts AS end_ts
        FROM requests, (VALUES (0, INTERVAL 8 HOUR), (1, INTERVAL 24 HOUR)) v(rank, span)""",
    "kinds": _values(OUTPUT_KINDS, "node_type, kind"),
    "support": _values(SUPPORT, "node_arch, node_type, supported"),
    "checked": """SELECT *, concat_ws(',', CASE WHEN node_name IS NULL THEN 'node_name' END,
        CASE WHEN sample_rate IS NULL THEN 'sample_rate' END, CASE WHEN audio_hw_id IS NULL THEN 'audio_hw_id' END,
        CASE WHEN channels IS NULL THEN 'channels' END, CASE WHEN node_type IS NULL THEN 'node_type' END,
        CASE WHEN stream_rate IS NULL THEN 'stream_rate' END,
        CASE WHEN segment_duration IS NULL THEN 'segment_duration' END,
        CASE WHEN node_arch IS NULL THEN 'node_arch' END) AS missing,
        CASE WHEN flac_duration IS NULL THEN 'flac_duration' ELSE '' END AS warnings FROM node_config""",
    "overridden": """SELECT node, node_name, node_type, bucket_type, channels, missing,
        CASE WHEN node_type = 'dev-virt-s3' THEN 48000 ELSE sample_rate END AS sample_rate,
        CASE WHEN node_type = 'dev-virt-s3' THEN 48000 ELSE stream_rate END AS stream_rate,
        CASE WHEN node_type = 'research' THEN 2 ELSE channels END AS live_channels FROM checked""",
    "moved": f"""SELECT event_id, substr(path, 6) || '/' || filename AS object_key, {_bucket('kind')} AS bucket
        FROM file_events""",
}

# Which fragments a fragment needs, in order.
NEEDS = {
    "names": ["catalog", "listing"], "stripped": ["names"], "timed": ["stripped"], "done": ["catalog"],
    "january": ["samples"], "scheduled": ["january"], "segments": ["scheduled"], "finished": ["file_events"],
    "items": ["catalog"], "tied": ["samples", "runs"], "playing": ["catalog", "ticks"], "gaps": ["samples"],
    "marked": ["gaps"], "islands": ["marked"], "wide_marked": ["gaps"], "near_ranges": ["requests"],
    "near_back": ["near_ranges"], "checked": ["node_config"], "overridden": ["checked"], "moved": ["file_events"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named fragments, what they need, and further ones before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({extra.get(n) or CTES[n]})" for n in order if n not in ("named_playlist",)]
    parts += [f"{n} AS ({q})" for n, q in extra.items() if n not in order]
    if "named_playlist" in names:
        parts.append(f"named_playlist AS ({CTES['named_playlist']})")
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _digits(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')"


_HEX = ("array_to_string(list_transform(samples, lambda x: format('{:02x}{:02x}', "
        "((greatest(-32768, least(32767, floor(x::DOUBLE * 32767 + 0.5)))::BIGINT + 65536) % 65536) % 256, "
        "((greatest(-32768, least(32767, floor(x::DOUBLE * 32767 + 0.5)))::BIGINT + 65536) % 65536) // 256)), '')")


def _le32(value: int) -> str:
    return value.to_bytes(4, "little").hex()


_HEAD = (b"RIFF".hex() + _le32(36 + 128) + b"WAVEfmt ".hex() + _le32(16) + "01000100" + _le32(48000)
         + _le32(96000) + "02001000" + b"data".hex() + _le32(128))

STATE = """CASE WHEN epoch_us({now}) - epoch_us(file_time) - 86400000000 > duration_s * 1000000 THEN 'expired'
    WHEN epoch_us({now}) - epoch_us(file_time) - 86400000000 > 0 THEN 'playing' ELSE 'pending' END"""
ELIGIBLE = f"file_time > {NOW} - INTERVAL 24 HOUR AND file_time < {NOW} - INTERVAL 18 HOUR"
COUNTERS = f"""count(*) AS listed, count(*) FILTER ({ELIGIBLE}) AS to_convert,
    count(*) FILTER ({STATE.format(now=NOW)} = 'playing') AS played,
    count(*) FILTER ({STATE.format(now=NOW)} IN ('playing', 'expired')) AS deleted"""
ODD = """SELECT node, seg_start + INTERVAL 7 MINUTE AS seg_start, seg_end - INTERVAL 11 MINUTE AS seg_end FROM segments"""
CUT = """SELECT node, run_id, seg_index, count(*) AS n_samples, min(ts) AS first_ts, max(ts) AS last_ts,
    make_timestamp(run_us + seg_index * {w}) AS seg_start
    FROM (SELECT *, (epoch_us(ts) - run_us) // {w} AS seg_index FROM {src} WHERE run_us IS NOT NULL) c
    GROUP BY node, run_us, run_id, seg_index"""
DEVICE_TIED = """SELECT s.*, epoch_us(r.started_at) AS run_us, epoch_us(r.started_at) // 1000000 AS run_id
    FROM device_samples s ASOF JOIN device_runs r ON s.node = r.node AND s.ts >= r.started_at"""
CLOCK = """SELECT node, make_timestamp({slot}) AS seg_start, make_timestamp({slot} + {w}) AS seg_end,
    count(*) AS n_samples, min(ts) AS first_ts, max(ts) AS last_ts FROM {src} GROUP BY ALL"""

ORACLES: dict[str, str] = {
    "listing_extract": sql("SELECT * FROM listing", "listing"),
    "build_catalog": sql("""SELECT url, filepath, file_time, CASE WHEN file_time IS NULL THEN 'bad' ELSE 'good' END AS kind
        FROM timed""", "timed"),
    "plan_listing_days": sql("""SELECT event_id, node, 'archive/' || strftime(day, '%Y/%m/%d') AS day_path FROM (
        SELECT event_id, node, unnest(generate_series((now_ts - delay)::DATE::TIMESTAMP, now_ts::DATE::TIMESTAMP,
        INTERVAL 1 DAY)) AS day FROM requests) d""", "requests"),
    "scan_days_pruned": sql("""SELECT node, file_time, filepath, strftime(file_time, '%Y-%m-%d') AS day FROM catalog
        WHERE strftime(file_time, '%Y-%m-%d') IN ('2024-01-15', '2024-01-16')""", "catalog"),
    "watch_tree_source": "SELECT event_id, ts, user_id, event_type, value FROM events",
    "move_sink": sql("""SELECT CASE WHEN bucket = '' THEN below ELSE bucket || '/' || below END AS object_key, length(content) AS n_bytes,
        md5(content) AS digest, CASE WHEN bucket = '' THEN 'tree' ELSE 'store' END AS place FROM objects""", "objects"),
    "tee_sinks": sql(f"""SELECT node, make_timestamp({_slot('ts', H)}) AS seg_start, count(*) AS n_samples,
        max(ts) AS last_ts, 'live' AS kind FROM samples GROUP BY ALL
        UNION ALL SELECT node, make_timestamp({_slot('ts', 6 * H)}), count(*), max(ts), 'archive'
        FROM samples GROUP BY ALL""", "samples"),
    "partition_layout": sql("""SELECT node, CASE WHEN event_id % 2 = 0 THEN 'hls' ELSE 'flac' END AS kind,
        strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS n_samples, min(event_id) AS first_id, max(ts) AS last_ts
        FROM samples GROUP BY ALL""", "samples"),
    "pcm_write_job": sql(f"""SELECT seg_id::VARCHAR AS seg_id, 172::BIGINT AS n_bytes, '{_HEAD}' || {_HEX} AS payload
        FROM frames""", "frames"),
    "pcm_read_job": sql(f"""SELECT seg_id::VARCHAR AS path,
        CASE WHEN seg_id % 10 <> 0 THEN 48000 END::INT AS rate, CASE WHEN seg_id % 10 <> 0 THEN 1 END::INT AS channels,
        CASE WHEN seg_id % 10 <> 0 THEN {_digits('''list_transform(samples, lambda y:
          (greatest(-32768, least(32767, floor(y::DOUBLE * 32767 + 0.5))) / 32767)::FLOAT)''')} END AS samples,
        CASE WHEN seg_id % 10 = 0 THEN 'cut short' END AS error FROM frames""", "frames"),
    "watch_tree_frames": sql(f"""SELECT seg_id::VARCHAR AS path,
        CASE WHEN seg_id % 10 <> 0 THEN 48000 END::INT AS rate, CASE WHEN seg_id % 10 <> 0 THEN 1 END::INT AS channels,
        CASE WHEN seg_id % 10 <> 0 THEN {_digits('''list_transform(samples, lambda y:
          (greatest(-32768, least(32767, floor(y::DOUBLE * 32767 + 0.5))) / 32767)::FLOAT)''')} END AS samples,
        CASE WHEN seg_id % 10 = 0 THEN 'cut short' END AS error FROM frames""", "frames"),

    "parse_file_time": sql("SELECT event_id, filepath, file_time AS parsed FROM catalog", "catalog"),
    "full_url": sql("SELECT event_id, url || '/' || filepath AS full_url FROM catalog", "catalog"),
    "derive_names": sql("""SELECT event_id, s || 'wav' AS wav_name, s || 'ts' AS ts_name,
        count(*) OVER (PARTITION BY s) > 1 AS name_collision
        FROM (SELECT event_id, replace(left(filepath, length(filepath) - 12), ':', '-') AS s FROM catalog) c""", "catalog"),
    "segment_names": sql(f"""SELECT event_id, seg_start, strftime(seg_start, '%Y-%m-%d') AS subdir,
        strftime(seg_start, '%Y-%m-%dT%H-%M-%S-%g') || '.wav' AS wav_name,
        '{PREFIX}' || strftime(seg_start, '%Y-%m-%dT%H-%M-%S-%g') || '.ts' AS ts_name
        FROM ({_schedule('ranges', 'INTERVAL 15 MINUTE', 'event_id')}) s""", "ranges"),
    "archive_name": sql(f"""SELECT node_name, seg_start, strftime(seg_start, '%Y-%m-%d_%H-%M-%S') || '_' || node_name ||
        '-' || sample_rate || '-' || channels || '.flac' AS archive_name FROM (
        SELECT DISTINCT node, make_timestamp({_slot('ts', 6 * H)}) AS seg_start FROM device_samples) s
        JOIN node_config USING (node)""", "device_samples", "node_config"),
    "live_name": sql(f"""SELECT node, run_id, seg_index, printf('live%03d.ts', seg_index) AS live_name
        FROM ({CUT.format(w=1_000_000, src='tied')}) c""", "tied"),
    "object_key": sql("SELECT event_id, substr(path, 6) || '/' || filename AS object_key FROM file_events", "file_events"),
    "bucket_route": sql(f"""SELECT node_name, bucket_type, kind, {_bucket('kind')} AS bucket, {_bucket('kind')} = '' AS unrouted
        FROM node_config, (VALUES ('hls'), ('flac')) k(kind)""", "node_config"),
    "gain": sql(f"SELECT seg_id, {_digits('list_transform(samples, lambda y: y::DOUBLE * 10000)')} AS samples FROM frames",
                "frames"),
    "interleave": sql(f"""SELECT seg_id, {_digits('''flatten(list_transform(range(1, 33), lambda i: [ch1[i], ch2[i]]))''')}
        AS samples FROM frames""", "frames"),
    "packet_pts": """SELECT event_id, trunc((epoch_us(ts) / 1000000 - (event_id % 1024)::DOUBLE / 48000
        - (event_id % 64 + event_id % 32)::DOUBLE / (2 * 48000)) * 1000000.0::DOUBLE)::BIGINT AS pts FROM events""",
    "apply_type_overrides": sql("SELECT node_name, node_type, sample_rate, stream_rate, live_channels FROM overridden",
                                "overridden"),

    "eligible_files": sql(f"SELECT * FROM catalog WHERE {ELIGIBLE}", "catalog"),
    "file_event_filter": sql("SELECT event_id, path, filename FROM finished", "finished"),
    "config_check": sql("SELECT node_name, missing, warnings, missing = '' AS passes FROM checked", "checked"),
    "queue_state": sql(f"SELECT event_id, filepath, {STATE.format(now=NOW)} AS state FROM catalog", "catalog"),

    "anti_done": sql("SELECT * FROM catalog WHERE filepath NOT IN (SELECT filepath FROM done)", "catalog", "done"),
    "skip_existing": sql("SELECT node, seg_start, ts_name FROM segments WHERE extract(hour FROM seg_start) % 4 <> 0", "segments"),
    "missing_segments": sql("""SELECT node, seg_start, seg_end FROM odd s WHERE NOT EXISTS (SELECT 1 FROM samples x
        WHERE x.node = s.node AND x.ts >= s.seg_start AND x.ts < s.seg_end)""", "segments", "samples", odd=ODD),
    "asof_run": sql("SELECT event_id, node, run_id FROM tied", "tied"),
    "playing_at": sql("SELECT tick, node, filepath FROM playing", "playing"),
    "next_available": sql("""SELECT t.node, t.tick, a.file_time AS next_time,
        epoch_us(a.file_time) - epoch_us(t.tick - INTERVAL 18 HOUR) AS wait_us
        FROM (SELECT * FROM ticks, (SELECT DISTINCT node FROM catalog WHERE node IS NOT NULL) n) t
        ASOF LEFT JOIN catalog a ON t.node = a.node AND t.tick - INTERVAL 24 HOUR < a.file_time
        ASOF LEFT JOIN (SELECT * FROM catalog WHERE filepath NOT IN (SELECT filepath FROM done)) o
          ON t.node = o.node AND t.tick - INTERVAL 24 HOUR < o.file_time
        WHERE o.file_time IS NULL OR o.file_time >= t.tick - INTERVAL 18 HOUR""", "catalog", "ticks", "done"),
    "node_outputs": sql("SELECT node_name, node_type, kind FROM node_config LEFT JOIN kinds USING (node_type)",
                        "node_config", "kinds"),
    "support_check": sql("""SELECT node_name, node_arch, node_type, coalesce(supported, false) AS supported
        FROM node_config LEFT JOIN support USING (node_arch, node_type)""", "node_config", "support"),

    "run_counters": sql(f"SELECT node, {COUNTERS} FROM catalog GROUP BY node", "catalog"),
    "segment_duration": sql(f"""SELECT node, seg_start, n AS n_samples, round(d, 6) AS duration_s,
        round(CASE WHEN d > 0 THEN (n - 1) / d END, 6) AS sample_rate FROM (
        SELECT node, make_timestamp({_slot('ts', H)}) AS seg_start, count(*) AS n,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS d FROM samples GROUP BY ALL) s""", "samples"),
    "latest_pointer": sql("""SELECT node, run_id, written_at FROM runs
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY written_at DESC, run_id DESC) = 1""", "runs"),
    "build_playlist": sql("SELECT node, subdir, body FROM named_playlist", "segments", "named_playlist",
                          to_list="SELECT * FROM segments"),
    "append_playlist": sql("SELECT node, subdir, body FROM named_playlist", "segments", "named_playlist",
                           to_list="SELECT * FROM segments"),
    "paged_playlist": sql("""SELECT node, '#EXTM3U' || chr(10) || '#EXT-X-TARGETDURATION:3600' || chr(10) ||
        string_agg('#EXTINF:3600.000000,' || chr(10) || ts_name, chr(10) ORDER BY extract(hour FROM seg_start) >= 12, seg_start)
        || chr(10) || '#EXT-X-ENDLIST' AS body FROM segments GROUP BY node""", "segments"),
    "downmix": sql(f"""SELECT seg_id, {_digits('''list_transform(range(1, 33), lambda i: (ch1[i] + ch2[i])::DOUBLE / 2.0::DOUBLE)''')}
        AS samples FROM frames""", "frames"),
    "resample_down": sql(f"""SELECT node, make_timestamp({_slot('ts', H)}) AS slot, round(avg(value), 6) AS value,
        count(*) AS n_samples FROM samples GROUP BY 1, 2""", "samples"),
    "resample_up": sql("""SELECT node, make_timestamp(g) AS slot,
        round(CASE WHEN g = us THEN v ELSE v + (nv - v) * (g - us) / (nus - us) END, 6) AS value FROM (
        SELECT *, unnest(generate_series(((us + 599999999) // 600000000) * 600000000, coalesce(nus - 1, us), 600000000)) AS g
        FROM (SELECT node, us, v, lead(us) OVER w AS nus, lead(v) OVER w AS nv FROM (
          SELECT node, epoch_us(ts) AS us, avg(value) AS v FROM samples GROUP BY ALL) p
          WINDOW w AS (PARTITION BY node ORDER BY us)) q) r""", "samples"),
    "gap_fill": sql("""SELECT g.node, g.segment, make_timestamp(g.slot) AS slot,
        round(coalesce(s.v - sum(s.total) OVER w / sum(s.n) OVER w, 0), 9) AS value FROM (
        SELECT node, seg_start AS segment, unnest(range(epoch_us(seg_start), epoch_us(seg_end), 600000000)) AS slot
        FROM odd) g LEFT JOIN (SELECT o.node, o.seg_start AS segment,
        epoch_us(o.seg_start) + ((epoch_us(ts) - epoch_us(o.seg_start)) // 600000000) * 600000000 AS slot, avg(value) AS v,
        sum(value) AS total, count(*) AS n FROM samples x JOIN odd o ON x.node = o.node AND ts >= o.seg_start AND ts < o.seg_end
        GROUP BY ALL) s ON g.node = s.node AND g.segment = s.segment AND g.slot = s.slot
        WINDOW w AS (PARTITION BY g.node, g.segment)""", "segments", "samples", odd=ODD),

    "run_segments": sql(CUT.format(w=600_000_000, src="tied"), "tied"),
    "clock_segments": sql(CLOCK.format(slot=f"((epoch_us(ts) - 420000000) // {H}) * {H} + 420000000", w=H, src="samples"),
                          "samples"),
    "xrun_flags": sql(f"SELECT event_id, node, gap_us, coalesce(gap_us > {H // 2}, false) AS xrun FROM gaps", "gaps"),
    "reset_islands": sql("SELECT node, first_ts, last_ts, n_packets FROM islands", "islands"),
    "clock_fit": sql("""SELECT node, first_ts, n_packets, floor(slope * 1e8 + 0.381966) / 1e8 AS slope, floor(intercept * 1e8 + 0.381966) / 1e8 AS intercept,
        floor(r2 * 1e8 + 0.381966) / 1e8 AS r2 FROM (
        SELECT node, first_ts, n AS n_packets, (n * xy - x * y)::DOUBLE / d::DOUBLE / 1000000 AS slope,
        (y * xx - x * xy)::DOUBLE / d::DOUBLE / 1000000 AS intercept,
        CASE WHEN d > 0 THEN CASE WHEN n * yy > y * y THEN (n * xy - x * y)::DOUBLE * (n * xy - x * y)::DOUBLE / d::DOUBLE / (n * yy - y * y)::DOUBLE
          ELSE 1 END END AS r2
        FROM (SELECT *, nullif(n * xx - x * x, 0) AS d FROM (
          SELECT node, min(ts) AS first_ts, count(*) AS n, sum(k) AS x, sum(t) AS y, sum(k * k) AS xx, sum(k * t) AS xy, sum(t::HUGEINT * t) AS yy
          FROM (SELECT *, row_number() OVER (PARTITION BY node, island ORDER BY ts, event_id) - 1 AS k,
            epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY node, island)) AS t FROM marked) m
          GROUP BY node, island) g) h) f""", "marked"),
    "stall_report": sql("""SELECT event_id, node, s AS silent_us, open FROM (SELECT *, next_ts IS NULL AS open,
        epoch_us(coalesce(next_ts, TIMESTAMP '2024-01-31')) - epoch_us(ts) AS s FROM gaps) g WHERE s > 10800000000""", "gaps"),
    "on_air_top1": sql("""SELECT node, tick, file_time, filepath FROM playing QUALIFY row_number() OVER
        (PARTITION BY node, tick ORDER BY file_time DESC, filepath DESC) = 1""", "playing"),
    "concat_timeline": sql("""SELECT list_id, pos, file, coalesce(sum(duration_s) OVER (PARTITION BY list_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS offset_s FROM items""", "items"),

    "segment_schedule": sql(_schedule("ranges", "INTERVAL 15 MINUTE", "event_id, node"), "ranges"),
    "loop_expand": sql("""SELECT list_id, loop_no * (max(pos) OVER l - min(pos) OVER l + 1) + pos - min(pos) OVER l AS pos, file
        FROM items, range(3) r(loop_no) WINDOW l AS (PARTITION BY list_id)""", "items"),
    "conversion_order": sql("""SELECT node, row_number() OVER (PARTITION BY node ORDER BY file_time, filepath) AS rank, filepath
        FROM catalog QUALIFY rank <= 50""", "catalog"),
    "near_and_backfill": sql("SELECT * FROM near_back", "near_back"),
    "accumulate_converted": sql("""SELECT filepath, event_id, CASE WHEN event_id % 3 <> 0 THEN 0 ELSE 1 END AS attempt
        FROM catalog""", "catalog"),

    "stream_poll_catalog": sql(f"SELECT node, file_time, filepath FROM catalog WHERE {ELIGIBLE}", "catalog"),
    "stream_polls": sql(f"""SELECT node, url, filepath, CASE WHEN file_time IS NULL THEN 'bad' ELSE 'eligible' END AS kind
        FROM timed WHERE file_time IS NULL OR ({ELIGIBLE})""", "timed"),
    "stream_dedup_done": sql("SELECT node, file_time, filepath FROM catalog", "catalog"),
    "stream_segments": sql(f"""SELECT node, seg_start, n_samples, last_ts
        FROM ({CLOCK.format(slot=_slot('ts', H), w=H, src='samples')}) c, mark WHERE epoch_us(seg_end) <= mark_us""",
                           "samples", "mark"),
    "stream_run_segments": sql(f"""SELECT c.* FROM ({CUT.format(w=600_000_000, src='tied')}) c, mark
        WHERE epoch_us(seg_start) + 600000000 <= mark_us""", "tied", "mark"),
    "stream_late_drop": sql("""SELECT filepath, event_id, CASE WHEN file_time <= (SELECT max(file_time) FROM catalog)
        - INTERVAL 10 DAY THEN 'late' ELSE 'kept' END AS outcome FROM catalog""", "catalog"),
    "stream_islands": sql(f"""SELECT node, first_ts, last_ts, n_packets FROM islands, mark
        WHERE epoch_us(last_ts) + {H // 2} <= mark_us""", "islands", "mark"),
    "stream_playout_queue": sql(f"""SELECT node, filepath, state, make_timestamp(at_us) AS "at" FROM (
        SELECT node, filepath, 'playing' AS state, epoch_us(file_time) + {24 * H} AS at_us FROM catalog UNION ALL
        SELECT node, filepath, 'expired', epoch_us(file_time) + {24 * H} + (duration_s * 1000000)::BIGINT FROM catalog) q, mark
        WHERE at_us < mark_us""", "catalog", "mark"),
    "stream_stall_alert": sql(f"""SELECT node, last_ts AS silent_since, last_ts + INTERVAL 1 HOUR AS alert_at FROM (
        SELECT node, island, max(ts) AS last_ts FROM wide_marked GROUP BY node, island) i, mark
        WHERE epoch_us(last_ts) + {H} <= mark_us""", "wide_marked", "mark"),
    "stream_latest_pointer": sql("""SELECT node, run_id, written_at FROM runs
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY written_at DESC, run_id DESC) = 1""", "runs"),
    "stream_upload": sql("""SELECT CASE WHEN moved THEN bucket || '/' || below ELSE below END AS object_key, length(content) AS n_bytes,
        md5(content) AS digest, CASE WHEN moved THEN 'store' ELSE 'tree' END AS place FROM (SELECT *, bucket <> '' AND
        (event_type = 'signup' OR (event_type = 'click' AND NOT contains(filename, 'tmp'))) AS moved FROM objects) o""", "objects"),
    "stream_counters": sql(f"SELECT {COUNTERS} FROM catalog", "catalog"),

    "delayed_playout": sql(f"""SELECT node, count(*) AS selected, count(*) FILTER (state = 'expired') AS expired,
        count(*) FILTER (state = 'playing') AS playing, count(*) FILTER (state = 'pending') AS pending,
        count(*) FILTER (state <> 'pending') AS deleted, count(*) FILTER (shared > 1) AS collisions FROM (
        SELECT *, {STATE.format(now=NOW + " + INTERVAL 3 HOUR")} AS state,
          count(*) OVER (PARTITION BY left(filepath, length(filepath) - 12)) AS shared FROM timed
        WHERE {ELIGIBLE} AND filepath NOT IN (SELECT filepath FROM done)) s GROUP BY node""", "timed", "done"),
    "day_playlists": sql("SELECT node, subdir, body FROM named_playlist", "near_back", "samples", "named_playlist",
                         to_list=f"""SELECT *, strftime(seg_start, '%Y-%m-%d') AS subdir,
        '{PREFIX}' || strftime(seg_start, '%Y-%m-%dT%H-%M-%S-%g') || '.ts' AS ts_name FROM near_back n
        WHERE NOT (extract(hour FROM seg_start) % 4 = 0 AND seg_start >= TIMESTAMP '2024-01-01')
          AND EXISTS (SELECT 1 FROM samples s WHERE s.node = n.node
                      AND s.ts >= n.seg_start AND s.ts < n.seg_end)"""),
    "live_to_store": sql(f"""SELECT node_name, kind, run_id, file_name, node_name || '/' || kind ||
        CASE WHEN kind = 'hls' THEN '/' || run_id ELSE '' END || '/' || file_name AS object_key,
        {_bucket('kind')} AS bucket, n_samples FROM (SELECT node_name, c.kind, run_id, bucket_type, n_samples,
          CASE WHEN c.kind = 'hls' THEN printf('live%03d.ts', seg_index)
          ELSE strftime(seg_start, '%Y-%m-%d_%H-%M-%S') || '_' || node_name || '-' || sample_rate || '-' || channels || '.flac'
          END AS file_name FROM (
            SELECT t.node, run_id, kind, seg_index, make_timestamp(run_us + seg_index * seconds * 1000000) AS seg_start,
              count(*) AS n_samples FROM (
                SELECT d.*, l.kind, l.seconds, (epoch_us(ts) - run_us) // (l.seconds * 1000000) AS seg_index
                FROM device_tied d JOIN (SELECT node, 'hls' AS kind, segment_duration::BIGINT AS seconds FROM node_config
                  UNION ALL SELECT node, 'flac', flac_duration::BIGINT FROM node_config WHERE flac_duration IS NOT NULL) l USING (node)
                WHERE run_us IS NOT NULL) t GROUP BY t.node, run_us, run_id, kind, seg_index, seconds) c
          JOIN overridden o ON o.node = c.node AND o.missing = ''
          JOIN (SELECT m.node FROM node_config m JOIN support USING (node_arch, node_type) WHERE supported) u ON u.node = c.node
          JOIN kinds k ON k.node_type = o.node_type AND k.kind = c.kind) f""",
                         "device_samples", "device_runs", "overridden", "kinds", "node_config", "support", device_tied=DEVICE_TIED),
}
