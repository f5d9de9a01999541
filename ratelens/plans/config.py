"""Constants of the study: seeds, sizes, thresholds, scenarios and hypotheses."""

from __future__ import annotations

# Fixed values.
MAIN_SPLIT_SEED = 42
SPLIT_SEEDS = (42, 123, 2024)
WEIGHT_SEEDS = (42, 123, 2024)
WEIGHT_SEEDS_LIGHT = (42,)
TEST_SIZE, VAL_SIZE = 0.20, 0.10
CV_FOLDS, CV_SEED, K_VALUES = 5, 42, (3, 5, 10)
INNER_CALIBRATION = 0.1
NUM_CLASSES, SEVERITY, MIN_CLASS = 5, 2, 20
FILTER_METHODS = ("confident_learning", "prune_by_noise_rate")
COCHRAN_Z, COCHRAN_P, COCHRAN_E = 1.96, 0.5, 0.10
HUMAN_N, MIN_PER_SEVERE_BIN, SEVERE_BINS = 100, 15, (2, 3, 4)
SECOND_ANNOTATOR, RETEST = 0.3, 0.10
SAMPLE_SEED, SECOND_SEED, RETEST_SEED = 42, 99, 77
UNDETERMINED = "ND"
N_BOOT, BOOT_SEED, ALPHA = 2000, 42, 0.05
QUOTAS = {1: 1200, 2: 900, 3: 900, 4: 1000, 5: 1200}
SCENARIOS = (
    {"name": "M1_Baseline_CE", "variant": "raw", "loss": "ce"},
    {"name": "M2_CleanedHard_CE", "variant": "hard", "loss": "ce"},
    {"name": "M3_CleanedSevere_CE", "variant": "severe", "loss": "ce"},
    {"name": "M4_Baseline_CORN", "variant": "raw", "loss": "corn"},
    {"name": "M5_CleanedHard_CORN", "variant": "hard", "loss": "corn"},
    {"name": "M6_CleanedSevere_CORN", "variant": "severe", "loss": "corn"},
)
HYPOTHESES = (
    ("H1_CORN_vs_CE_raw", "M4_Baseline_CORN", "M1_Baseline_CE"),
    ("H2_SeverityAware_vs_Base", "M6_CleanedSevere_CORN", "M4_Baseline_CORN"),
    ("H3_HardPrune_vs_Base", "M5_CleanedHard_CORN", "M4_Baseline_CORN"),
    ("H4_SeverityAware_vs_Hard", "M6_CleanedSevere_CORN", "M5_CleanedHard_CORN"),
    ("H5_SeverityAware_vs_Base_CE", "M3_CleanedSevere_CE", "M1_Baseline_CE"),
)


def scenario_by_name(name: str) -> dict[str, str]:
    found = [s for s in SCENARIOS if s["name"] == name]
    if not found:
        raise KeyError(name)
    return found[0]
