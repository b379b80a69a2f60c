"""Names, patterns, limits and formats that results depend on.

They are plain data. Everything that uses them takes them as a default
argument, so another dataset only passes its own.
"""

# --- fixed values: trial metadata format -----------------------------------
METADATA_COLUMNS = ["locutor", "arquivo", "codec", "transmissao",
                    "ataque", "label", "trim", "fase"]
ID_PATTERN = r"^LA_[A-Z]_\d+$"
ATTACK_PATTERN = r"^A\d{2}$"
LABEL_DOMAIN = ["bonafide", "spoof"]
NEGATIVE_LABEL = "bonafide"
AUDIO_SUFFIX = ".flac"
DETECTION_LINES = 200

# --- fixed values: split and sampling --------------------------------------
SEED = 42
SPLIT_PARTS = [("treino", 0.70), ("validacao", 0.15), ("teste", 0.15)]
SPLIT_TOLERANCE = 1e-9
FOLDS = 5
RARE_STRATUM_ROWS = 10
RARE_STRATUM_NAME = "outros"
SHARED_SAMPLE_ROWS = 30000
CURVE_SIZES = [5000, 10000, 20000, 40000, 80000, None]
SATURATION_TOLERANCE = 0.005

# --- fixed values: reports --------------------------------------------------
CODEC_BANDS = {"alaw": "estreita", "ulaw": "estreita", "gsm": "estreita",
               "pstn": "estreita", "g722": "larga", "opus": "larga",
               "none": "larga"}
CODEC_ORDER = ["alaw", "ulaw", "gsm", "pstn", "g722", "opus", "none"]
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
              0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
LEAK_F1 = 0.60
STRONG_CORRELATION = 0.3
BIAS_PERCENT = 5.0
LOW_SHARE_MEAN = 0.3
ERROR_TEXT_CHARS = 160
HISTOGRAM_BINS = 50
NOT_FEATURES = ["arquivo", "label", "classe_binaria", "prop_fala", "conjunto",
                "ataque"]

# --- fixed values: waveform preparation and short-time features -------------
SAMPLE_RATE = 16000
SECONDS = 4.0
SILENT_PEAK = 1e-8
VAD_FRAME_MS = 30
VAD_RATES = [8000, 16000, 32000, 48000]
N_MFCC = 20
N_FFT = 512
HOP = 256
WIN = 400
N_MELS = 128

# --- fixed values: published column names, ours -> theirs -------------------
PUBLISHED_NAMES = {
    "threshold": "limiar",
    "recall_0": "recall_bonafide",
    "recall_1": "recall_spoof",
    "precision_0": "precisao_bonafide",
    "precision_1": "precisao_spoof",
    "f1_0": "f1_bonafide",
    "f1_1": "f1_spoof",
    "accuracy": "acuracia",
    "baseline_accuracy": "acuracia_baseline_trivial",
    "eer_threshold": "limiar_eer",
    "n_0": "n_bonafide",
    "mean_score": "media_prob_spoof",
    "f1_shared": "f1_vs_bonafide",
    "eer_shared": "eer_vs_bonafide",
    "n_train": "n_treino",
    "n_valid": "n_validacao",
    "fit_seconds": "tempo_treino_s",
    "tn": "cm_bonafide_como_bonafide",
    "fp": "cm_bonafide_como_spoof",
    "fn": "cm_spoof_como_bonafide",
    "tp": "cm_spoof_como_spoof",
}
