"""Rule tables of disclosures and forum claims. Operators take them as parameters; these are the defaults."""

from __future__ import annotations

# Topics of claims in bit order, with the pattern of each.
TOPIC_PATTERNS = [
    ("rights_issue", r"(?i:rights?\s*issue|\bpmhmetd\b|\bhmetd\b|penawaran umum terbatas|\bput\s+[ivx]+\b)|\b[A-Z]{4}-R\b"),
    ("private_placement", r"(?i:private\s*placement|\bpmthmetd\b|tanpa (?:memberikan )?hmetd)|(?<![Gg]rup )(?<![Gg]roup )\bPP\b"),
    ("tender_offer", r"(?i:tender\s*offer|penawaran tender|tender wajib|\bmto\b|\bvto\b|\btender\b(?!\s+(?:proyek|pengadaan)))|\bTO\b"),
    ("akuisisi_pengendali", r"(?i:akuisisi|diakuisisi|mengakuisisi|pengambilalihan|ambil\s?alih|diambil\s?alih|take\s?over|pengendali baru|ganti pengendali|perubahan pengendali|berganti pengendali|backdoor|cangkang|\bcspa\b|term sheet|investor strategis|calon pembeli|injeksi aset|asset injection|inbreng|diambil oleh|dicaplok)"),
    ("merger", r"(?i:\bmerger\b|penggabungan usaha|peleburan)"),
    ("buyback", r"(?i:buy\s?back|pembelian kembali saham|saham treasuri)"),
    ("stock_split", r"(?i:stock\s?split|reverse\s?split|pemecahan (?:nilai )?(?:nominal )?saham|\bsplit\b)"),
    ("dividen", r"(?i:dividen|dividend)"),
    ("suspensi_uma", r"(?i:suspen\w*|disuspen\w*|\buma\b|unusual market|cooling down|digembok)"),
    ("go_private", r"(?i:go\s?private|delisting|\bdelist\w*|penghapusan pencatatan)"),
    ("kontrak", r"(?i:kontrak|\bmou\b|kerja\s?sama|pengadaan|proyek baru)"),
    ("kepemilikan", r"(?i:pemegang saham|kepemilikan|memegang saham|pemilik|\bowner\b|\bholder\b|insider|\bksei\b|menjual saham|membeli saham|crossing|pasar nego)"),
    ("pailit", r"(?i:pailit|\bpkpu\b|likuidasi|dilikuidasi|bangkrut)"),
    ("rups", r"(?i:\brups\w*|kuorum|rapat umum)"),
]

# Topics that are corporate actions, those that change control, and the categories of disclosures that can carry a topic.
ACTION_TOPICS = ["rights_issue", "private_placement", "tender_offer", "akuisisi_pengendali", "merger", "buyback", "stock_split", "go_private", "pailit"]
CONTROL_TOPICS = ["akuisisi_pengendali", "tender_offer", "go_private", "merger"]
TOPIC_CATEGORIES = {
    "akuisisi_pengendali": ["pengurus_pengendali", "aksi_korporasi"],
    "rights_issue": ["struktur_modal", "aksi_korporasi"],
    "private_placement": ["struktur_modal", "aksi_korporasi"],
    "tender_offer": ["aksi_korporasi", "pengurus_pengendali"],
    "merger": ["aksi_korporasi"],
    "buyback": ["aksi_korporasi", "struktur_modal"],
    "stock_split": ["aksi_korporasi", "struktur_modal"],
    "go_private": ["aksi_korporasi", "regulasi_bursa"],
    "pailit": ["hukum", "aksi_korporasi", "lainnya"],
}

# Relation classes, the first that fits counts; a share deal needs the word "saham" too.
RELATION_PATTERNS = [
    ("kreditur", r"(?i:pinjaman|fasilitas kredit|kreditur|kreditor|\bbank\b|utang)"),
    ("transaksi_saham", r"(?i:penjualan|pembelian|pengalihan|pengambilalihan|term sheet|\bcspa\b|tender|\bvto\b|\bmto\b|inbreng|menjual|membeli|mengakuisisi|akuisisi|divestasi)"),
    ("anak_usaha", r"(?i:anak usaha|entitas anak|anak perusahaan|subsidiary|entitas asosiasi)"),
    ("afiliasi", r"(?i:afiliasi|terafiliasi|pihak berelasi|hubungan istimewa)"),
]
SHARE_WORD = r"(?i)\bsaham\b"

# Ordinary words that are codes too, words beside which a code in lower case counts, categories that are read for mentions.
CODE_WORDS = "aksi laba uang asli area daya real live kbli jaya food nice best safe home good care indo data pada naik".split()
CUES = ["saham", "emiten", "tbk"]
MENTION_CATEGORIES = ["bei-ringkasan", "bei-detail", "keterbukaan-informasi"]
LEGAL_WORDS = r"\((?:Persero)\)|\b(?:PT|Tbk|TBK|Persero|d/h)\b|[^\w\s&-]"

# Words of selling and buying in claims, and words of party names that tell no party apart.
SELL = r"(?i:menjual|jual|melepas|lepas|distribusi|buang|keluar|mengurangi|dilepas|guyur)"
BUY = r"(?i:membeli|beli|akumulasi|menambah|nampung|menampung|borong|serok)"
GENERIC_TOKENS = """INDONESIA INVESTAMA NUSANTARA SEJAHTERA MANDIRI INTERNASIONAL INTERNATIONAL UTAMA PERSADA SENTOSA ABADI GROUP GLOBAL CAPITAL ASIA PRIMA JAYA
MAKMUR BANK INVESTMENT INVESTMENTS HOLDINGS HOLDING PERKASA LESTARI MULIA SUKSES TRADING KARYA BERSAMA SEKURITAS SECURITIES ASURANSI LIMITED PRIVATE MITRA DANA
INVESTINDO SARANA CIPTA""".split()

# Types of corporate action with their patterns in texts, what names a rights issue beside a placement without rights, and
# the headings of a digest that tell facts.
ACTION_PATTERNS = [
    ("rights_issue", r"(?i)rights? issue|\bPMHMETD\b|penawaran umum terbatas|\bHMETD\b"),
    ("private_placement", r"(?i)private placement|\bPMTHMETD\b|tanpa (memberikan )?(HMETD|hak memesan)"),
    ("stock_split", r"(?i)stock split|reverse (stock )?split|pemecahan (nilai nominal )?saham|penggabungan nilai nominal"),
    ("buyback", r"(?i)buy ?back|pembelian kembali saham|(pengalihan|penjualan|pelepasan) (kembali )?saham treasuri"),
    ("tender_offer", r"(?i)tender offer|penawaran tender"),
    ("go_private", r"(?i)go[ -]private|delisting|penghapusan pencatatan|perusahaan tertutup"),
    ("acquisition", r"(?i)akuisisi|mengakuisisi|pengambilalihan|mengambil alih|\bacquisition\b|\btakeover\b"),
    ("control_change", r"(?i)perubahan pengendali|pengendali baru|backdoor|reverse takeover"),
    ("business_change", r"(?i)\bKBLI\b|(perubahan|penambahan|perluasan) (maksud dan tujuan serta )?kegiatan usaha"),
    ("merger", r"(?i)\bmerger\b|penggabungan usaha|peleburan"),
    ("dividend", r"(?i)dividen (tunai|interim|final)|cash dividend|pembagian dividen"),
    ("bonus_shares", r"(?i)saham bonus|bonus shares"),
]
RIGHTS_ALONE = r"(?i)rights? issue|\bPMHMETD\b|penawaran umum terbatas"
DIGEST_HEADINGS = ["Corporate actions", "Capital structure", "Material changes", "Management / control changes", "Listing / regulatory"]

# Further patterns of questions only; the abbreviation of a tender offer counts in capitals.
QUESTION_PATTERNS = {
    "rights_issue": r"(?i)\bright\b",
    "private_placement": r"(?i)\bpp\b",
    "stock_split": r"(?i)\bsplit\b",
    "tender_offer": r"\bTO\b",
    "go_private": r"(?i)\bdelist|cabut dari bursa|keluar dari bursa",
    "acquisition": r"(?i)anorganik|caplok",
    "control_change": r"(?i)ganti pengendali|ganti pemilik",
    "business_change": r"(?i)ekspansi|bisnis baru|ganti bisnis|\bpivot\b",
    "dividend": r"(?i)\bdivi\b|dividen",
}

# Sentences that name roles of persons, parties and services, words that are no names, titles, and words of companies.
PERSON_ROLE = r"\b(Presiden Direktur|Direktur Utama|Direktur Independen|Direktur|Presiden Komisaris|Komisaris Utama|Komisaris Independen|Komisaris)\s+(?:baru\s+)?(?:(?:Drs?|Ir|H|Hj|Prof|dr)\.?\s+)?([A-Z][A-Za-z'-]+(?:\s+(?:[A-Z][A-Za-z'.-]+|bin|binti)){1,4})"
PARTY_ROLE = r"\b(Pembeli|Penjual|Pengendali baru|Pengendali|Calon pengendali)\s*[:=]?\s+((?:PT\.?\s+)?[A-Z][A-Za-z'.&-]+(?:\s+[A-Z][A-Za-z'.&-]+){1,5})"
PARTY_AFTER = r"((?:PT\.?\s+)?[A-Z][A-Za-z'.&-]+(?:\s+[A-Z][A-Za-z'.&-]+){1,5})\s*\((Pembeli|Penjual(?: \d)?|Pengendali)\)"
SERVICE_ROLE = r"\b(BAE|Biro Administrasi Efek|KAP|Kantor Akuntan Publik)\s+((?:PT\.?\s+)?[A-Z][A-Za-z'.&,-]+(?:\s+(?:[A-Z&][A-Za-z'.&,-]*|dan)){1,6})"
NAME_STOP = """Perseroan Keuangan Kepatuhan Bisnis Niaga Operasional Non No Nomor Independen TI Finance Armada Pemasaran Manajemen Siaga Periode Oleh Baru
Perusahaan Utama Tbk Rapat Umum Pemegang Saham Dewan Direksi Komisaris Direktur Sekretaris Teknik Produksi Investasi Hukum Sumber Daya Manusia Risiko Kredit
Ritel Korporasi Usaha Syariah Digital Teknologi Informasi Pengembangan Strategi Komersial Lama Sebelumnya Semua Seluruh Para Yang Dan Atas Untuk Dalam Pada
Sebagai Selaku Indonesia Jakarta Laporan Anggaran Dasar Akta Surat Berdasarkan Sesuai Tanggal Bapak Ibu Sdr Sdri Tuan Nyonya""".split()
TITLE = r"^(?:Drs?|Ir|H|Hj|Prof|dr|Bapak|Ibu|Tuan|Nyonya)\.?\s+"
FIRM = r"(?i)\b(PT|TBK|LTD|LIMITED|PTE|INC|CORP|CORPORATION|LLC|B\.?V|N\.?V|HOLDINGS?|GROUP|CAPITAL|FUND|BANK|INVESTAMA|INVESTMENT|SEKURITAS|ASURANSI|KOPERASI|YAYASAN|DANA PENSIUN|PERSERO|SA|AG)\b"

# Texts that name a group, which of their two parts is the group, and whether the other is a member or the owner.
GROUP_PATTERNS = [
    (r"PT\.? ([A-Z][\w ]+?),? (?:disebut |merupakan )?bagian (?:dari )?(?:[Gg]rup |[Gg]roup )?([A-Z]\w+)(?: Group| Grup)?\b", 2, "member"),
    (r"\b([A-Z]\w+) Group melalui PT\.? ([A-Z][\w ]+?)(?=[,.;)]|\s(?:yang|dan|sebagai)\b|$)", 1, "member"),
    (r"((?:PT\.? )?[A-Z][\w]+(?: [A-Z][\w]+){0,4}) \((?:[Gg]rup|[Gg]roup) ([A-Z]\w+)\)", 2, "member"),
    (r"\b(?:[Gg]rup|[Gg]roup) ([A-Z]\w+) milik '?([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})", 1, "owner"),
]
