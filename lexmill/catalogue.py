"""Expected numbers of predictions per task, required result sets, array shapes."""

FAST_SIZES = {
    "blimp": 200,
    "blimp_supplement": 50,
    "ewok": 100,
    "entity_tracking": {
        "regular_0_ops": 606, "regular_1_ops": 607, "regular_2_ops": 606, "regular_3_ops": 606,
        "regular_4_ops": 568, "regular_5_ops": 159,
    },
    "reading": 1726,
    "wug_adj": 200,
    "wug_past": 50,
}

FULL_SIZES = {
    "blimp": {
        "superlative_quantifiers_2": 986, "superlative_quantifiers_1": 979, "anaphor_gender_agreement": 971,
        "principle_a_reconstruction": 967, "irregular_past_participle_adjectives": 961,
        "sentential_subject_island": 961, "wh_island": 960, "left_branch_island_simple_question": 951,
        "coordinate_structure_constraint_object_extraction": 949, "tough_vs_raising_1": 948,
        "left_branch_island_echo_question": 947, "principle_a_c_command": 946,
        "regular_plural_subject_verb_agreement_2": 945, "irregular_past_participle_verbs": 942,
        "determiner_noun_agreement_with_adj_2": 941, "principle_a_domain_3": 941,
        "determiner_noun_agreement_with_adjective_1": 933, "anaphor_number_agreement": 931,
        "determiner_noun_agreement_2": 931, "existential_there_quantifiers_1": 930,
        "determiner_noun_agreement_1": 929, "matrix_question_npi_licensor_present": 929,
        "adjunct_island": 928, "existential_there_subject_raising": 924, "animate_subject_trans": 923,
        "drop_argument": 920, "tough_vs_raising_2": 920, "wh_vs_that_with_gap": 919,
        "sentential_negation_npi_licensor_present": 919, "principle_a_case_2": 915,
        "principle_a_domain_2": 915, "principle_a_domain_1": 914, "npi_present_2": 914,
        "principle_a_case_1": 912, "existential_there_quantifiers_2": 911,
        "wh_vs_that_with_gap_long_distance": 910, "npi_present_1": 909,
        "coordinate_structure_constraint_complex_left_branch": 906, "passive_2": 903,
        "wh_questions_subject_gap": 898, "animate_subject_passive": 895,
        "irregular_plural_subject_verb_agreement_2": 892, "regular_plural_subject_verb_agreement_1": 890,
        "only_npi_licensor_present": 882, "wh_vs_that_no_gap_long_distance": 875,
        "distractor_agreement_relative_clause": 871, "sentential_negation_npi_scope": 871,
        "intransitive": 868, "transitive": 868, "wh_vs_that_no_gap": 861, "wh_questions_object_gap": 859,
        "wh_questions_subject_gap_long_distance": 857, "inchoative": 855, "complex_np_island": 846,
        "passive_1": 840, "determiner_noun_agreement_with_adj_irregular_2": 840, "only_npi_scope": 837,
        "ellipsis_n_bar_2": 828, "determiner_noun_agreement_irregular_2": 820, "causative": 818,
        "existential_there_object_raising": 812, "irregular_plural_subject_verb_agreement_1": 804,
        "ellipsis_n_bar_1": 802, "distractor_agreement_relational_noun": 788,
        "expletive_it_object_raising": 759, "determiner_noun_agreement_with_adj_irregular_1": 718,
        "determiner_noun_agreement_irregular_1": 681,
    },
    "blimp_supplement": {
        "hypernym": 842, "qa_congruence_easy": 64, "qa_congruence_tricky": 165,
        "subject_aux_inversion": 3867, "turn_taking": 280,
    },
    "ewok": {
        "agent-properties": 2210, "social-relations": 1548, "physical-relations": 818,
        "material-dynamics": 770, "physical-interactions": 556, "spatial-relations": 490,
        "social-properties": 328, "quantitative-properties": 314, "social-interactions": 294,
        "material-properties": 170, "physical-dynamics": 120,
    },
    "entity_tracking": {
        "regular_0_ops": 606, "regular_1_ops": 607, "regular_2_ops": 606, "regular_3_ops": 606,
        "regular_4_ops": 568, "regular_5_ops": 159,
        "ambiref_0_ops": 607, "ambiref_1_ops": 607, "ambiref_2_ops": 604, "ambiref_3_ops": 604,
        "ambiref_4_ops": 615, "ambiref_5_ops": 187,
        "move_contents_0_ops": 605, "move_contents_1_ops": 606, "move_contents_2_ops": 605,
        "move_contents_3_ops": 606, "move_contents_4_ops": 529, "move_contents_5_ops": 156,
    },
    "comps": {"base": 49340, "wugs_dist_before": 13896, "wugs_dist_in_between": 13896, "wugs": 13896},
    "reading": 1726, "wug_adj": 200, "wug_past": 50, "winoground": 746, "vqa": 25230,
    "boolq": 1635, "mnli": 4908, "mrpc": 204, "multirc": 2424, "qqp": 20215, "rte": 139, "wsc": 52,
}

AOA_ROWS_PER_STEP = 8005

ARRAY_SHAPES = {"things": (1854, 1854), "trog": (76, 4, 1), "lex-viz_vocab": (119, 4, 1)}

FAST_SETS = (
    ("blimp", "blimp_fast"), ("blimp", "supplement_fast"), ("ewok", "ewok_fast"),
    ("entity_tracking", "entity_tracking_fast"), ("wug_adj", "wug_adj_nominalization"),
    ("wug_past", "wug_past_tense"), ("reading", "reading"),
)
CLASSIFICATION_TASKS = ("boolq", "mnli", "mrpc", "multirc", "qqp", "rte", "wsc")
FULL_SETS = tuple((t, t) for t in CLASSIFICATION_TASKS) + (
    ("blimp", "blimp_filtered"), ("blimp", "supplement_filtered"), ("ewok", "ewok_filtered"),
    ("entity_tracking", "entity_tracking"), ("wug_adj", "wug_adj_nominalization"),
    ("wug_past", "wug_past_tense"), ("comps", "comps"), ("reading", "reading"), ("AoA_word", "surprisal"),
)
MULTIMODAL_SETS = FULL_SETS + (
    ("vqa", "vqa_filtered"), ("winoground", "winoground_filtered"), ("devbench", "lex-viz_vocab"),
    ("devbench", "gram-trog"), ("devbench", "sem-things_pairwise_sims"),
)
REQUIRED_SETS = {"full": FULL_SETS, "fast": FAST_SETS, "multimodal": MULTIMODAL_SETS}
