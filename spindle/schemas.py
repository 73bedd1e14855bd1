"""Shapes of the catalogue tables (data model D5 to D17 of the survey)."""

from __future__ import annotations

SHARD = "shard string, source string, source_hash string, source_size long, tokens long, documents long, shard_mb double"
MERGED_REF = "struct<shard:string,source:string,tokens:long>"
MERGED_SHARD = f"shard string, source string, domain string, tokens long, documents long, shard_mb double, merged_from array<{MERGED_REF}>"
MANIFEST = "tokenization_id string, shards array<struct<shard:string,source:string,source_hash:string,source_size:long,tokens:long,documents:long,shard_mb:double>>"
MERGED_MANIFEST = (
    "tokenization_id string, merged_from string, merge_target_bytes long, merge_fingerprint string, "
    f"shards array<struct<shard:string,source:string,domain:string,tokens:long,documents:long,shard_mb:double,merged_from:array<{MERGED_REF}>>>"
)
META = "num_tokens long, num_shards long, vocab_size long, eot_id long, pad_id long, tokenizer string, shard_dtype string, tokenization_id string"
EVAL_PIN = "tokenization_id string, eval_seed long, eval_fraction_per_source double, max_eval_shards_per_source int, shards array<string>, selected_from string"
DATA_MIX = "ord int, domain string, weight double, max_epochs int"
TRAINING_MANIFEST = (
    "tokenization_id string, status string, checkpoint_step long, "
    "data_selection struct<data_mix:map<string,double>,selected_shards:long,selected_tokens:long,sources:map<string,struct<passes:long,tokens:long,unique:array<string>>>>"
)
SFT_RAW = "instruction string, input string, output string"
SFT_TOKENS = "input_ids array<int>, prefix_len int"
PROVENANCE = (
    "source_txt string, source_file string, source_domain string, source_tokens long, source_shard string, merged_shard string, merged_domain string, merged_tokens long, "
    "merged_mb double, selected_for_training string, eval_heldout string, training_weight double, selected_domain_passes long, selected_domain_tokens long"
)
