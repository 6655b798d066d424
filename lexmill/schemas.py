"""Canonical schemas (DDL strings) and task constants."""

DOCS = "doc_id bigint, text string, ord bigint, source string"
LINES = "file string, line_no bigint, text string"
ITEMS = (
    "task string, uid string, idx bigint, sentences array<string>, prefixes array<string>, "
    "completions array<string>, label int, ratio double, facets map<string,string>"
)
PREDICTION_ENTRY = "struct<id:string,pred:string,prob:double,prev_pred:double>"
PREDICTIONS_DOCUMENT = f"map<string,struct<predictions:array<{PREDICTION_ENTRY}>>>"
ARTICLE = "url string, title string, content string, timestamp string, _corrupt_record string"
SURPRISAL = (
    "step string, word_count bigint, target_word string, context_id int, context string, surprisal double"
)

# Raw JSONL layout per ranking task.
RAW_ITEMS = {
    "blimp": (
        "sentence_good string, sentence_bad string, field string, UID string, linguistics_term string"
    ),
    "ewok": (
        "Domain string, ConceptA string, ConceptB string, ContextType string, ContextDiff string, "
        "TargetDiff string, Context1 string, Context2 string, Target1 string, Target2 string"
    ),
    "wug": "sentences string, ratio double",
    "entity_tracking": "input_prefix string, options array<string>, numops int",
    "comps": "prefix_acceptable string, prefix_unacceptable string, property_phrase string",
    "vqa": "question string, target_ans string, distractors array<string>, idx_in_hf_dataset int",
    "winoground": (
        "caption_0 string, caption_1 string, collapsed_tag string, tag string, secondary_tag string, "
        "image_idx int, image_key string"
    ),
}

# Text fields of each classification task: left and right input.
CLASSIFICATION_FIELDS = {
    "boolq": ("question", "passage"),
    "mnli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "rte": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "cola": ("sentence",),
    "sst2": ("sentence",),
}

# Reading-time regressions: dependent variables and predictors of the base model.
READING_VARIABLES = (
    "RTfirstfix", "RTfirstpass", "RTgopast", "RTrightbound", "self_paced_reading_time",
    "ELAN", "LAN", "N400", "P600", "EPNP", "PNP",
)
READING_BASE = ("Subtlex_log10", "length", "context_length")
READING_SPILLOVER = READING_BASE + ("prev_length", "prev_pred")
