"""They must equal those of the engine whose results are to be matched.  They are defaults of parameters."""

from __future__ import annotations

DIMENSIONS = ("GPU intensity", "Display quality", "Portability", "Multitasking", "Processing speed")
TIERS = ("low", "medium", "high")

#: feature -> tier -> keywords; what has none of them is medium.
KEYWORDS = {
    "GPU intensity": {
        "high": ["rtx 4090", "rtx 4080", "rtx 4070", "rtx 4060", "rtx 3080", "rtx 3070", "rtx 3060", "rx 7900", "rx 7800", "rx 6800", "rx 6700", "dedicated gpu", "discrete gpu", "16gb vram", "16 gb vram", "12gb vram", "12 gb vram", "8gb vram", "8 gb vram", "6gb vram", "6 gb vram"],
        "low": ["intel uhd", "intel hd", "integrated graphics", "integrated gpu", "no dedicated", "onboard", "vega 8", "vega 7", "radeon graphics", "iris plus"],
    },
    "Display quality": {
        "high": ["4k", "oled", "amoled", "retina", "3840", "2880", "mini-led", "miniled", "120hz", "144hz", "165hz", "240hz", "hdr", "dolby vision", "2560x1600", "2560x1440", "qhd", "wqhd", "2560 x 1600", "2560 x 1440", "2k resolution"],
        "low": ["hd+", "1366x768", "1366 x 768", "hd ready", "tn panel", "720p", "768p"],
    },
    "Portability": {
        "high": ["ultrabook", "ultra book", "under 1 kg", "under 1kg", "0.9 kg", "0.9kg", "1.0 kg", "1.0kg", "1.1 kg", "1.1kg", "1.2 kg", "1.2kg", "1.3 kg", "1.3kg", "1.4 kg", "1.4kg", "thin and light", "thin & light", "slim", "compact", "macbook air", "ultraslim", "featherlight"],
        "low": ["2.5 kg", "2.5kg", "2.6 kg", "2.6kg", "2.7 kg", "2.7kg", "2.8 kg", "2.8kg", "2.9 kg", "2.9kg", "3 kg", "3.0 kg", "3.0kg", "desktop replacement", "workstation", "17 inch", "17-inch", "17.3"],
    },
    "Multitasking": {
        "high": ["64gb ram", "64 gb ram", "64 gb", "64gb", "32gb ram", "32 gb ram", "32 gb", "32gb", "lpddr5x", "lpddr5"],
        "low": ["8gb ram", "8 gb ram", "8 gb", "8gb", "4gb ram", "4 gb ram", "4 gb", "4gb", "lpddr4", "ddr4"],
    },
    "Processing speed": {
        "high": ["core i9", "intel i9", "i9-", "i9 ", "ryzen 9", "ryzen9", "m3 pro", "m3 max", "m2 pro", "m2 max", "m1 pro", "m1 max", "xeon", "core ultra 9", "snapdragon x elite"],
        "low": ["core i5", "intel i5", "i5-", "i5 ", "core i3", "intel i3", "i3-", "i3 ", "ryzen 5", "ryzen5", "ryzen 3", "ryzen3", "celeron", "pentium", "core ultra 5", "snapdragon 8cx"],
    },
}
TOPICS = {
    "GPU": ["gpu", "graphics", "rtx", "gtx", "radeon", "vram", "nvidia", "amd gpu", "intel arc", "uhd graphics"],
    "Display": ["display", "screen", "resolution", "fhd", "4k", "retina", "oled", "ips", "nits", "hz", "refresh"],
    "Portability": ["weight", "kg", "portable", "thin", "light", "slim", "compact", "battery"],
    "Multitasking": ["ram", "gb ram", "memory", "multitask"],
    "Processing": ["cpu", "processor", "core i", "ryzen", "intel", "amd", "ghz", "m1", "m2", "m3"],
}
BRANDS = ["dell", "hp", "lenovo", "asus", "acer", "apple", "msi", "razer", "samsung", "lg", "microsoft", "huawei"]
USE_CASES = {
    "gaming": ["gaming", "fps", "esports"],
    "creator": ["editing", "rendering", "design", "creator", "video"],
    "business": ["business", "office", "productivity", "enterprise"],
    "student": ["student", "college", "budget"],
    "development": ["developer", "coding", "programming", "devops"],
}
#: Upper bounds, exclusive; what is above the last, or below nought, is "flagship".
PRICE_BANDS = (("budget", 50_000), ("mid", 100_000), ("premium", 200_000))
SPECS = {
    "HAS_GPU": r"\b((?:nvidia )?(?:geforce )?(?:rtx|gtx)\s*\d{3,4}(?:\s*ti)?|radeon\s+[\w ]{2,20}|iris\s+xe)\b",
    "HAS_CPU": r"\b((?:intel )?core\s*i[3579](?:-\d{4,5}[a-z]*)?|(?:amd )?ryzen\s*[3579](?:\s*\d{4,5}[a-z]*)?|apple\s*m[1-4](?:\s*(?:pro|max))?)\b",
    "HAS_RAM": r"\b(\d{1,3}\s*gb\s*(?:ddr[45]|lpddr\w*)?\s*ram)\b",
    "HAS_STORAGE": r"\b((?:\d+(?:\.\d+)?\s*(?:tb|gb))\s*(?:ssd|nvme|storage))\b",
    "HAS_DISPLAY": r"\b((?:\d{3,4}\s*[x×]\s*\d{3,4})|(?:oled|ips|mini led))\b",
    "HAS_REFRESH_RATE": r"\b(\d{2,3}\s*hz)\b",
    "WEIGHS": r"\b(\d(?:\.\d+)?\s*kg)\b",
}
REQUIREMENT = r"(?i)I need a laptop with\s+(\w+)\s+GPU intensity[,\s]+(\w+)\s+display quality[,\s]+(\w+)\s+portability[,\s]+(\w+)\s+multitasking[,\s]+(\w+)\s+processing speed[\s\w]*budget\s+of\s+([\d,]+)"
PICK = r"(?m)^\s*\d+\.\s+\*\*(.+?)\*\*\s*[—\-–]\s*₹?\s*([\d,]+(?:\.\d+)?)"
HOPS, TOP_TRIPLETS, TOP_ITEMS, FLAT_DIM = 2, 25, 8, 64
RRF_K, BM25_K1, BM25_B = 60, 1.5, 0.75
RETRIEVAL_K, CORRECT, BUDGET_CAP, UNLIMITED = 10, 0.65, 90_000, 10_000_000
FIELD_WEIGHT, PRICE_WEIGHT = 0.7, 0.3
CASE_SCORE, CASE_CORRECT = 0.65, 0.70
JUDGE_FIELDS = ("comprehensiveness", "diversity", "empowerment", "directness", "factual_accuracy", "specificity", "coherence", "conciseness", "helpfulness")
RETRIEVAL_CRITERIA = ("comprehensiveness", "factual_accuracy", "specificity")
ANSWER_CRITERIA = ("directness", "coherence", "conciseness", "helpfulness")
#: Words of a free text that hint at a feature.
TEXT_HINTS = {
    "GPU intensity": ["rtx", "gtx", "vram", "graphics"],
    "Processing speed": ["core i", "ryzen", "m1", "m2", "m3", "celeron"],
    "Multitasking": ["gb ram", "ram"],
}
