"""Word lists, lookup tables, patterns and limits that results depend on."""

# --- fixed values: literal patterns, in scan order (pattern_id 1..10) ---------------
LITERAL_PATTERNS = [
    r"""Text\s*\(\s*['"]([^'"$]+)['"]""",
    r"""text\s*:\s*['"]([^'"$]+)['"]""",
    r"""title\s*:\s*['"]([^'"$]+)['"]""",
    r"""label\s*:\s*['"]([^'"$]+)['"]""",
    r"""hintText\s*:\s*['"]([^'"$]+)['"]""",
    r"""labelText\s*:\s*['"]([^'"$]+)['"]""",
    r"""content\s*:\s*Text\s*\(\s*['"]([^'"$]+)['"]""",
    r"""message\s*:\s*['"]([^'"$]+)['"]""",
    r"""return\s+['"]([^'"$]+)['"]""",
    r"""=\s*['"]([^'"$]+)['"]""",
]

# --- fixed values: file and directory names that hold localization code -------------
LOCALIZATION_FILE_PARTS = [
    "localizations",
    "messages_",
    "app_localizations",
    "_generated.dart",
    "_intl.dart",
    "internationalization",
]
LOCALIZATION_DIRS = ["l10n", "generated", "intl", "internationalization", "localization"]

# --- fixed values: files that are never rewritten ----------------------------------
REWRITE_SKIP_PARTS = [
    "app_images.dart",
    "app_assets.dart",
    "app_icons.dart",
    "app_colors.dart",
    "assets.dart",
    "images.dart",
    "icons.dart",
    "colors.dart",
    "generated/",
]

# --- fixed values: folders that never hold catalogs --------------------------------
CATALOG_SKIP_FOLDERS = [
    "build",
    "node_modules",
    "android",
    "ios",
    "web",
    "windows",
    "macos",
    "linux",
    "test",
    "integration_test",
    ".dart_tool",
]

# --- fixed values: limits ----------------------------------------------------------
MAX_FILE_CHARS = 1024 * 1024
FREE_QUOTA_CHARS = 500_000
CHARS_PER_STRING_ESTIMATE = 20
QUOTA_NEAR_PERCENT = 80
REVIEW_BATCH = 10

# --- fixed values: noise rules over the trimmed literal ----------------------------
NUMBER_PATTERN = r"^[0-9]+(\.[0-9]+)?$"
SYMBOLS_PATTERN = r"^[\.\,\:\;\!\?\-\+\*\/\=\(\)\[\]\{\}\s]+$"

# --- fixed values: default country of a bare language ------------------------------
DEFAULT_COUNTRY = {
    "en": "US", "af": "ZA", "ar": "SA", "de": "DE", "es": "ES", "fr": "FR",
    "it": "IT", "ja": "JP", "ko": "KR", "pt": "PT", "ru": "RU", "zh": "CN",
}

# --- fixed values: catalog languages, in column order ------------------------------
LANGUAGE_CODES = [
    "app_en", "app_af", "app_sq", "app_am", "app_ar", "app_hy", "app_az", "app_bn", "app_eu",
    "app_be", "app_bg", "app_my", "app_ca", "app_zh", "app_zh_hk", "app_hr", "app_cs", "app_da",
    "app_nl", "app_et", "app_fil", "app_fi", "app_fr", "app_gl", "app_ka", "app_de", "app_el",
    "app_gu", "app_he", "app_hi", "app_hu", "app_is", "app_id", "app_it", "app_ja", "app_kn",
    "app_kk", "app_km", "app_ko", "app_ky", "app_lo", "app_lv", "app_lt", "app_mk", "app_ms",
    "app_ml", "app_mr", "app_mn", "app_ne", "app_no", "app_fa", "app_pl", "app_pt", "app_pa",
    "app_ro", "app_ru", "app_sr", "app_si", "app_sk", "app_sl", "app_es", "app_sw", "app_sv",
    "app_ta", "app_te", "app_th", "app_tr", "app_uk", "app_vi", "app_zu",
]
LANGUAGE_NAMES = [
    "ENGLISH - en", "AFRIKAANS - af", "Albanian - sq", "Amharic - am", "Arabic - ar",
    "Armenian - hy", "Azerbaijani - az", "Bangla - bn", "Basque - eu", "Belarusian - be",
    "Bulgarian - bg", "Burmese - my", "Catalan - ca", "Chinese Simplified - zh-CN",
    "Chinese Traditional - zh-HK", "Croatian - hr", "Czech - cs", "Danish - da", "Dutch - nl",
    "Estonian - et", "Filipino - fil", "Finnish - fi", "French - fr", "Galician - gl",
    "Georgian - ka", "German - de", "Greek - el", "Gujarati - gu", "Hebrew - he", "Hindi - hi",
    "Hungarian - hu", "Icelandic - is", "Indonesian - id", "Italian - it", "Japanese - ja",
    "Kannada - kn", "Kazakh - kk", "Khmer - km", "Korean - ko", "Kyrgyz - ky", "Lao - lo",
    "Latvian - lv", "Lithuanian - lt", "Macedonian - mk", "Malay - ms", "Malayalam - ml",
    "Marathi - mr", "Mongolian - mn", "Nepali - ne", "Norwegian - no", "Persian - fa",
    "Polish - pl", "Portuguese - pt", "Punjabi - pa", "Romanian - ro", "Russian - ru",
    "Serbian - sr", "Sinhala - si", "Slovak - sk", "Slovenian - sl", "Spanish - es",
    "Swahili - sw", "Swedish - sv", "Tamil - ta", "Telugu - te", "Thai - th", "Turkish - tr",
    "Ukrainian - uk", "Vietnamese - vi", "Zulu - zu",
]

# --- fixed values: language codes the translation service accepts -------------------
SERVICE_LANGUAGES = [
    "BG", "CS", "DA", "DE", "EL", "EN", "ES", "ET", "FI", "FR", "HU", "ID", "IT", "JA", "KO", "LT",
    "LV", "NB", "NL", "PL", "PT", "RO", "RU", "SK", "SL", "SV", "TR", "UK", "ZH", "ACE", "AF", "SQ",
    "AR", "AN", "HY", "AS", "AY", "AZ", "BA", "BE", "BN", "BHO", "BS", "BR", "MY", "YUE", "CA",
    "CEB", "ZH-HANS", "ZH-HANT", "HR", "PRS", "GA", "GN", "GU", "HT", "HA", "HE", "HI", "IS", "IG",
    "JV", "PAM", "KK", "GOM", "KMR", "CKB", "KY", "LA", "LN", "LMO", "LB", "MK", "MAI", "MG", "ML",
    "MT", "MI", "MR", "MN", "NE", "OC", "OM", "PAG", "PS", "FA", "PT-BR", "PT-PT", "PA", "QU", "SA",
    "ST", "SCN", "SU", "TL", "TG", "TA", "TT", "TE", "TH", "TS", "TN", "TK", "UR", "UZ", "CY", "WO",
    "XH", "YI", "ZU",
]
