"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex(text || ' <eos>', '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
_IDS = f"list_transform({_WORDS}, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT)"
_COUNTED = f"(SELECT doc_id, source AS dataset, len({_WORDS})::BIGINT AS num_tokens FROM documents)"
_OFFSETS = f"(SELECT *, (coalesce(sum(num_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS o FROM {_COUNTED})"
_POS = f"(SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS p FROM (SELECT doc_id, {_IDS} AS ids FROM documents))"
_SPANS = f"(SELECT doc_id, seq, greatest(o, seq * 2048) - seq * 2048 AS block_offset, greatest(o, seq * 2048) - o AS doc_offset, least(o + num_tokens, (seq + 1) * 2048) - greatest(o, seq * 2048) AS n FROM (SELECT *, unnest(range(o // 2048, (o + num_tokens - 1) // 2048 + 1)) AS seq FROM {_OFFSETS} WHERE num_tokens > 0))"
_DIST = f"(SELECT dataset, sum(num_tokens)::BIGINT AS tokens, round(sum(num_tokens) / sum(sum(num_tokens)) OVER (), 4) AS percentage FROM {_COUNTED} GROUP BY dataset)"
_SAMPLE = "(SELECT doc_id, source AS dataset, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS rn FROM documents) WHERE {})"
_SOME = _SAMPLE.format("(source = 'src0' AND rn <= 10) OR (source = 'src1' AND rn <= 5) OR (source = 'src2' AND rn <= 7)")
_ALL = _SAMPLE.format("(source = 'src0' AND rn <= 10) OR (source = 'src1' AND rn <= 5) OR (source = 'src2' AND rn <= 7) OR source = 'src3'")
_BATCH = "(SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id, (row_number() OVER (ORDER BY doc_id) - 1) % 16 AS pos FROM documents)"
_CUT = f"(SELECT t.doc_id, batch_id, ids[1:512] AS ids, max(len(ids[1:512])) OVER (PARTITION BY batch_id) AS w FROM (SELECT doc_id, {_IDS} AS ids FROM documents) t JOIN {_BATCH} b USING (doc_id))"
_RUNS = "(SELECT user_id AS run, event_id AS step, value AS val_loss FROM events)"
_NAMES = "(SELECT unnest(['src0', 'src1', 'src2', 'absent_a', 'absent_b']) AS dataset)"
_EPOCHS = "(SELECT event_id, event_id // 200 AS epoch, event_id % 200 + CASE WHEN event_id // 200 % 7 = 3 THEN 150 ELSE 0 END AS step, event_id % 7 + 1 AS n FROM events)"
_CKPT = "(SELECT value AS val_loss, event_id AS step, 'ckpt/' || event_id AS path FROM events)"

_ONE_RUN = "(SELECT *, CASE WHEN action <> 'none' AND l > 0 THEN l END AS carried_loss FROM (SELECT *, CASE WHEN (step + 1) % 10 = 0 THEN 'validate' WHEN (step + 1) % 4 = 0 THEN 'save' ELSE 'none' END AS action, last_value(CASE WHEN (step + 1) % 10 = 0 THEN val_loss END IGNORE NULLS) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM (SELECT event_id AS step, value AS val_loss FROM events)))"
# One save after the other: s is the list of kept ones, the first of which goes next.
_HISTORY = f"""
WITH RECURSIVE due AS (SELECT row_number() OVER (ORDER BY step) AS i, step, action = 'save' AS forced, coalesce(carried_loss, 'inf'::DOUBLE) AS loss FROM {_ONE_RUN} WHERE action <> 'none'),
     h AS (SELECT 0::BIGINT AS i, []::STRUCT(low DOUBLE, step BIGINT, path VARCHAR)[] AS s, NULL::BIGINT AS step, NULL::BOOLEAN AS forced, NULL::BOOLEAN AS admitted, NULL::VARCHAR AS removed
           UNION ALL
           SELECT i, CASE WHEN NOT enters THEN s WHEN len(more) > 5 THEN more[2:] ELSE more END, step, forced, enters, CASE WHEN enters AND len(more) > 5 THEN more[1].path END
           FROM (SELECT d.i, d.step, d.forced, s, d.forced OR len(s) < 5 OR d.loss < -s[1].low AS enters, list_sort(list_append(s, {{'low': -d.loss, 'step': d.step, 'path': 'checkpoint-step' || (d.step + 1)}})) AS more FROM h JOIN due d ON d.i = h.i + 1))
SELECT step, forced, admitted, removed, array_to_string(list_reverse(list_transform(s, lambda x: x.path)), ',') AS kept FROM h WHERE i > 0"""
_LOG = "(SELECT event_id, event_id % 7 + 1 AS n, ((event_id + 1) % 200 = 0 OR event_id % 997 = 500)::INT AS ended, event_id % 1500 = 1499 AS back FROM events)"
_SEGMENTS = f"(SELECT *, max(CASE WHEN back THEN event_id END) OVER (ORDER BY event_id) AS r FROM {_LOG})"
_COUNTERS = f"(SELECT *, row_number() OVER w AS k, sum(n) OVER w AS t, coalesce(sum(ended) OVER (PARTITION BY r ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM {_SEGMENTS} WINDOW w AS (PARTITION BY r ORDER BY event_id))"
# Batches, then what the first and the second session leave, numbered anew.
_WORLDS = """
WITH b AS (SELECT DISTINCT batch_id AS i FROM {batch}),
     s0 AS (SELECT i, i AS j, i % 4 AS rank, i // 4 AS turn, i // 4 < [2, 1, 2, 2][i % 4 + 1] AS took FROM b),
     s1 AS (SELECT i, j, j % 3 AS rank, j // 3 AS turn, j // 3 < [1, 0, 1][j % 3 + 1] AS took FROM (SELECT i, row_number() OVER (ORDER BY i) - 1 AS j FROM s0 WHERE NOT took)),
     s2 AS (SELECT i, j % 5 AS rank, j // 5 AS turn FROM (SELECT i, row_number() OVER (ORDER BY j) - 1 AS j FROM s1 WHERE NOT took)),
     a AS (SELECT i, 0 AS session, rank, turn FROM s0 WHERE took UNION ALL SELECT i, 1, rank, turn FROM s1 WHERE took UNION ALL SELECT i, 2, rank, turn FROM s2)
SELECT doc_id, session, rank, turn FROM {batch} JOIN a ON a.i = batch_id"""

ORACLES: dict[str, str] = {
    "scan_project_text": "SELECT text FROM documents",
    "tag_source": "SELECT doc_id, text, 'web' AS dataset FROM documents",
    "drop_helper_columns": "SELECT doc_id, text, source FROM documents",
    "exclude_sources": "SELECT doc_id, 'data/' || source || '/part.parquet' AS path FROM documents WHERE NOT contains('data/' || source || '/part.parquet', 'src1')",
    "mixture_whitelist": "SELECT source AS dataset, count(*) AS n_rows FROM documents WHERE source IN ('src0', 'src1', 'src2', 'absent_a', 'absent_b') GROUP BY source",
    "missing_sources": f"SELECT dataset FROM {_NAMES} WHERE dataset NOT IN (SELECT source FROM documents)",
    "append_eos": "SELECT doc_id, text || '<|eos|>' AS text FROM documents",
    "tokenize_native": f"SELECT doc_id, count(*) AS n_tokens, sum(id * (p + 1))::BIGINT AS checksum FROM {_POS} GROUP BY doc_id",
    "token_counts": f"SELECT doc_id, num_tokens FROM {_COUNTED}",
    "token_distribution": f"SELECT * FROM {_DIST}",
    "token_distribution_sorted": f"SELECT dataset, coalesce(tokens, 0) AS tokens, coalesce(percentage, 0.0) AS percentage FROM {_NAMES} LEFT JOIN {_DIST} USING (dataset)",
    "pack_sequences": f"SELECT g // 2048 AS seq, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs, sum(id * (g % 2048 + 1))::BIGINT AS checksum FROM (SELECT *, row_number() OVER (ORDER BY doc_id, p) - 1 AS g FROM {_POS}) GROUP BY 1",
    "pack_doc_spans": f"SELECT * FROM {_SPANS}",
    "pack_tail": f"SELECT seq, sum(n)::BIGINT AS n_tokens FROM {_SPANS} GROUP BY seq ORDER BY seq DESC LIMIT 1",
    "packing_stats": f"SELECT ceil(sum(num_tokens) / 2048)::BIGINT AS total_sequences, sum(num_tokens)::BIGINT AS total_tokens, count(*) AS num_examples, round(sum(num_tokens) / ceil(sum(num_tokens) / 2048), 6) AS avg_tokens_per_sequence, round(count(*) / ceil(sum(num_tokens) / 2048), 6) AS avg_examples_per_sequence FROM {_COUNTED}",
    "mixture_sample": f"SELECT doc_id, dataset, text FROM {_SOME}",
    "mixture_sample_keep_all": f"SELECT doc_id, dataset FROM {_ALL}",
    "rows_per_source": f"SELECT dataset, count(*) AS n_rows FROM {_ALL} GROUP BY dataset",
    "mixture_proportions": f"SELECT dataset, count(*) AS n_rows, (sum(count(*)) OVER ())::BIGINT AS total_rows, round(count(*) / sum(count(*)) OVER (), 3) AS proportion FROM {_ALL} GROUP BY dataset",
    "train_test_split": "SELECT doc_id, CASE WHEN r < ceil(0.1::DOUBLE * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split, r AS shuffle_rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS r FROM documents)",
    "val_head": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50",
    "eval_limit": "SELECT 'five' AS setting, item_id FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 5) UNION ALL SELECT 'zero', item_id FROM benchmark UNION ALL SELECT 'none', item_id FROM benchmark",
    "union_sources": "SELECT text, source AS dataset FROM documents UNION ALL SELECT text, 'conversations' FROM conversations UNION ALL SELECT text, 'benchmark' FROM benchmark",
    "scan_jsonl_parquet_union": "SELECT text, 'mixed' AS dataset FROM documents UNION ALL SELECT text, 'mixed' FROM benchmark",
    "token_offsets": f"SELECT doc_id, num_tokens, o AS token_offset FROM {_OFFSETS}",
    "cumulative_tokens": f"SELECT doc_id, num_tokens, o + 1000 AS tokens_before, o + 1000 + num_tokens AS tokens_seen FROM {_OFFSETS}",
    "token_budget_cut": f"SELECT doc_id, num_tokens, o + 1000 + num_tokens AS tokens_seen FROM {_OFFSETS} WHERE o = 0 OR o + 1000 < 200000",
    "batch_assign": f"SELECT doc_id, batch_id, pos FROM {_BATCH}",
    "resume_skip_batches": f"SELECT doc_id, batch_id, pos FROM {_BATCH} WHERE batch_id >= 3",
    "shard_batches": f"SELECT doc_id, batch_id, pos FROM {_BATCH} WHERE batch_id % 4 = 1",
    "collate_pad": f"SELECT doc_id, batch_id, w::BIGINT AS width, list_sum(list_transform(ids, lambda x, i: x * i))::BIGINT AS checksum FROM {_CUT}",
    "attention_mask": f"SELECT doc_id, w::BIGINT AS width, len(ids)::BIGINT AS n_real, (len(ids) * (len(ids) + 1) // 2)::BIGINT AS checksum FROM {_CUT}",
    "label_mask": f"SELECT doc_id, (w - len(ids))::BIGINT AS n_ignored, (list_sum(list_transform(ids, lambda x, i: x * i)) - 100 * (w * (w + 1) // 2 - len(ids) * (len(ids) + 1) // 2))::BIGINT AS checksum FROM {_CUT}",
    "tokens_per_step": f"SELECT batch_id, sum(num_tokens)::BIGINT AS tokens FROM {_COUNTED} JOIN {_BATCH} USING (doc_id) GROUP BY batch_id",
    "loss_per_step": "SELECT event_id % 97 AS step, sum(value::DECIMAL(18, 6))::DOUBLE AS loss_sum FROM events GROUP BY 1",
    "val_loss_mean_of_means": "SELECT round(avg(l), 4) AS val_loss FROM (SELECT r, avg(l) AS l FROM (SELECT event_id % 4 AS r, event_id // 64 AS b, avg(value) AS l FROM events GROUP BY 1, 2) GROUP BY r)",
    "log_every_n": "SELECT event_id AS step, round(value, 4) AS loss FROM events WHERE event_id % 7 = 0",
    "lr_schedule": "SELECT event_id AS step, round(0.0003::DOUBLE * (0.0003::DOUBLE / 500 + (1 - 0.0003::DOUBLE / 500) * least(event_id, 500) / 500.0::DOUBLE), 10) AS lr FROM events",
    "checkpoint_schedule": f"SELECT run, step, action, CASE WHEN action <> 'none' AND l > 0 THEN l END AS carried_loss FROM (SELECT *, CASE WHEN (step + 1) % 10 = 0 THEN 'validate' WHEN (step + 1) % 4 = 0 THEN 'save' ELSE 'none' END AS action, last_value(CASE WHEN (step + 1) % 10 = 0 THEN val_loss END IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM {_RUNS})",
    "checkpoint_schedule_one_run": f"SELECT step, action, carried_loss FROM {_ONE_RUN}",
    "checkpoint_history": _HISTORY,
    "epoch_counters": f"SELECT event_id, (coalesce(r // 400, 0) + e)::BIGINT AS epoch, ((row_number() OVER (PARTITION BY r, e ORDER BY event_id)) + CASE WHEN e = 0 THEN coalesce(r % 200 // 2, 0) ELSE 0 END)::BIGINT AS step_in_epoch, coalesce(r - 50, 0) + k AS global_step, (coalesce(r * 3, 0) + t)::BIGINT AS tokens_seen FROM {_COUNTERS}",
    "resume_other_world": _WORLDS.format(batch=_BATCH),
    "rewrite_split": "SELECT doc_id, split, CASE WHEN split = 'test' THEN 'new: ' ELSE '' END || text AS text FROM documents JOIN (SELECT doc_id, CASE WHEN r < ceil(0.1::DOUBLE * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS r FROM documents)) USING (doc_id)",
    "packed_slice": f"SELECT g // 2048 AS seq, count(*) AS n_tokens, sum(id * (g % 2048 + 1))::BIGINT AS checksum FROM (SELECT *, row_number() OVER (ORDER BY doc_id, p) - 1 AS g FROM {_POS}) WHERE g // 2048 >= 20 AND g // 2048 < 50 GROUP BY 1",
    "file_differences": "WITH o AS (SELECT source AS dataset, sum(strlen(text) + 1)::BIGINT AS old_bytes FROM documents GROUP BY 1), n AS (SELECT source AS dataset, sum(strlen(text) + CASE WHEN source = 'src2' THEN 2 ELSE 1 END)::BIGINT AS new_bytes FROM documents WHERE source <> 'src1' GROUP BY 1 UNION ALL SELECT 'extra', sum(strlen(text) + 1)::BIGINT FROM documents WHERE source = 'src3') SELECT dataset, CASE WHEN old_bytes IS NULL THEN 'new' WHEN new_bytes IS NULL THEN 'gone' WHEN old_bytes = new_bytes THEN 'same' ELSE 'changed' END AS status, old_bytes, new_bytes FROM o FULL JOIN n USING (dataset)",
    "token_report_read": f"SELECT dataset, coalesce(tokens, 0) AS tokens, coalesce(percentage, 0.0) AS percentage, (SELECT sum(tokens)::BIGINT FROM {_DIST}) AS total_tokens FROM {_NAMES} LEFT JOIN {_DIST} USING (dataset)",
    "metric_stream": "SELECT event_id // 4 AS step, round(avg(value), 4) AS train_loss, sum(event_id % 7 + 1)::BIGINT AS tokens FROM events WHERE event_id // 4 % 7 = 0 GROUP BY 1",
    "evaluate_tasks": "SELECT 7::BIGINT AS step, unnest(m) AS metric, round(unnest(v), 6) AS value FROM (SELECT ['eval/long/share', 'eval/long/chars', 'eval/long/num_samples'] AS m, [avg((length(text) > 200)::INT), avg(length(text)), count(*)] AS v FROM benchmark UNION ALL SELECT ['eval/words/the', 'eval/words/num_samples'], [avg(contains(text, 'the')::INT), count(*)] FROM documents UNION ALL SELECT ['eval/few/chars', 'eval/few/num_samples'], [avg(length(text)), count(*)] FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 5) UNION ALL SELECT ['eval/broken/error'], [1.0])",
    "topk_checkpoints": f"SELECT * FROM {_CKPT} ORDER BY val_loss, step DESC, path DESC LIMIT 5",
    "best_checkpoint": f"SELECT * FROM {_CKPT} ORDER BY val_loss, step DESC, path DESC LIMIT 1",
    "checkpoint_admission": f"SELECT a.run, a.step, count(b.step) < 5 AS admitted FROM {_RUNS} a LEFT JOIN {_RUNS} b ON a.run = b.run AND b.step < a.step AND b.val_loss <= a.val_loss GROUP BY a.run, a.step",
    "checkpoint_names": "SELECT event_id, printf('checkpoint-step%d-loss%.4f', event_id, value::DECIMAL(18, 4)::DOUBLE) AS name, printf('%s_step%d.json', event_type, event_id) AS eval_file FROM events",
    "eval_metrics_long": "SELECT event_id AS step, 'eval/' || event_type || '/' || m AS metric, CASE WHEN m = 'acc' THEN value ELSE user_id::DOUBLE END AS value FROM events, (SELECT unnest(['acc', 'user']) AS m) WHERE user_id % 2 = 0 AND event_id % 5 <> 0",
    # The driver runs these queries at this scale; file names are all that a view can't tell.
    "source_file_manifest": "SELECT 'sf0.01' AS dataset, parse_filename(file) AS name FROM glob('/root/testdata/sf0.01/*.parquet')",
    "files_by_top_folder": "SELECT 'sf0.01' AS dataset, 'sf0.01' AS top, substr(file, length('/root/testdata/sf0.01/') + 1) AS path FROM glob('/root/testdata/sf0.01/**/*.parquet')",
    "merge_source_files": "SELECT text FROM documents UNION ALL SELECT text FROM benchmark",
    "mean_loss_per_step": "SELECT event_id % 97 AS step, round(avg(value), 4) AS loss FROM events GROUP BY 1",
    "stop_at_steps": f"SELECT epoch, step FROM {_EPOCHS} WHERE step < 120 OR (epoch % 7 = 3 AND step = 150)",
    "stop_at_tokens_first": f"SELECT epoch, step, (40 + s)::BIGINT AS tokens_seen FROM (SELECT *, sum(n) OVER (ORDER BY event_id) AS s FROM {_EPOCHS}) WHERE event_id = 0 OR 40 + s - n < 20000",
    "resume_from_last": f"SELECT (b - 1) // 10 AS epoch, b AS global_step, (b - 1) % 10 + 1 AS step_in_epoch, t AS tokens_seen, true AS fresh FROM (SELECT count(DISTINCT batch_id) AS b FROM {_BATCH}), (SELECT sum(num_tokens)::BIGINT AS t FROM {_COUNTED})",
    "packing_summary": f"SELECT format('{{:,}}', ceil(sum(num_tokens) / 2048)::BIGINT) AS sequences, format('{{:,}}', sum(num_tokens)::BIGINT) AS tokens, printf('%.1f', round(sum(num_tokens) / ceil(sum(num_tokens) / 2048), 4)) AS per_sequence, printf('%.2f', round(count(*) / ceil(sum(num_tokens) / 2048), 4)) AS examples FROM {_COUNTED}",
    "checkpoint_prunes": f"SELECT run, step, 'ckpt/' || gone AS removed FROM (SELECT *, max(CASE WHEN gone = step THEN r END) OVER (PARTITION BY run, step) AS own FROM (SELECT a.run, a.step, b.step AS gone, row_number() OVER (PARTITION BY a.run, a.step ORDER BY b.val_loss, b.step DESC) AS r FROM {_RUNS} a JOIN {_RUNS} b ON a.run = b.run AND b.step <= a.step)) WHERE (own <= 6 AND r = 6) OR (own > 6 AND gone = step)",
    "last_checkpoints": f"SELECT run, max(step) AS step, run || '/last' AS path FROM {_RUNS} GROUP BY run",
}
