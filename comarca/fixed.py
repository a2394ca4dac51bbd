"""Code lists, place tables and label tables that results depend on."""

# Column order of the headerless registry file.
RAW_COLUMNS = [
    "cnpj_basico", "cnpj_ordem", "cnpj_dv", "identificador_matriz_filial", "nome_fantasia",
    "situacao_cadastral", "data_situacao_cadastral", "motivo_situacao_cadastral",
    "nome_cidade_exterior", "pais", "data_inicio_atividade", "cnae_fiscal_principal",
    "cnae_fiscal_secundaria", "tipo_logradouro", "logradouro", "numero", "complemento", "bairro",
    "cep", "uf", "codigo_municipio", "municipio", "ddd_1", "telefone_1", "ddd_2", "telefone_2",
    "ddd_fax", "fax", "correio_eletronico", "situacao_especial", "data_situacao_especial",
    "porte_empresa",
]

# Columns kept by the broad file extract.
KEPT_COLUMNS = [
    "cnpj_basico", "cnpj_ordem", "cnpj_dv", "nome_fantasia", "cnae_fiscal_principal", "logradouro",
    "numero", "bairro", "cep", "telefone_1", "porte_empresa", "municipio",
]

# Columns that an upsert of establishments refreshes on a key match.
UPSERT_COLUMNS = [
    "nome_fantasia", "cnae_fiscal", "logradouro", "numero", "bairro", "municipio",
    "business_type", "situacao_cadastral",
]

ACTIVE = 2

# City codes of the two extracts.
CITY_CODES_BROAD = [4113700, 4103701, 4109807, 4101408, 4112108]
CITY_CODES_TECH = [4113700, 4103701, 4109807, 4122404, 4101507, 4101408, 4103800, 4112108]

# Activity codes of the broad extract.
RETAIL_CODES = [
    "4711301", "4711302", "4712100", "4713000", "4721101", "4721102", "4721103", "4722901",
    "4722902", "4723700", "4724500", "4729601", "4729602", "4729603", "4729699", "4731800",
    "4732600", "4741500", "4742300", "4743100", "4744001", "4744002", "4744003", "4751201",
    "4751202", "4752100", "4753900", "4754701", "4754702", "4755501", "4755502", "4756300",
    "4757100", "4759801", "4759899", "4761001", "4761002", "4761003", "4762800", "4763601",
    "4763602", "4763603", "4763604", "4763605", "4771701", "4771702", "4771703", "4771704",
    "4771705", "4771706", "4771799", "4772500", "4773300", "4774100", "4781400", "4782201",
    "4782202", "4783101", "4783102", "4784900", "4785701", "4785702", "4785799", "4789001",
    "4789002", "4789099",
]
GASTRONOMY_CODES = [
    "5611201", "5611202", "5611203", "5611204", "5611205", "5612100", "5613900", "5620101",
    "5620102", "5620103", "5620104",
]
TECH_CODES_BROAD = [
    "6201501", "6202300", "6203100", "6204000", "6209100", "6311900", "6319400", "4751201",
    "4751202", "4752100", "4753900", "4651400", "4652200", "4652201", "4652202", "6110801",
    "6110802", "6110803", "6120501", "6120502", "6130200", "6190601", "6190602", "6190699",
    "9511800", "9512600", "8599603",
]
REPAIRS_CODES_BROAD = ["9511800", "9512600", "9521500", "9529104", "9529199"]

# Activity codes of the technology-only extract.
TECH_CODES = ["6201501", "6202300", "6209100"]
REPAIRS_CODES = ["9511800", "9512600"]

# Sector filters of the map.
SECTORS = {
    "software": ["6201501", "6202300"],
    "support": ["6209100"],
    "repairs": ["9511800", "9512600"],
}

# Target cities of the registry-table extract and their display names.
CITY_NAMES = {
    "LONDRINA": "Londrina",
    "CAMBE": "Cambé",
    "IBIPORA": "Ibiporã",
    "ROLANDIA": "Rolândia",
    "ARAPONGAS": "Arapongas",
    "APUCARANA": "Apucarana",
    "CAMBIRA": "Cambira",
    "JANDAIA DO SUL": "Jandaia do Sul",
}

# Commercial hubs (id, name, lng, lat, zone, type bias, density text).
HUBS = [
    (1, "Centro (Calçadão)", -51.1610, -23.3110, "Zona Central",
     "Soporte TI & Reparación Express",
     "Gran volumen de tiendas de reparación y venta de accesorios para móviles y periféricos."),
    (2, "Gleba Palhano (Av. Ayrton Senna)", -51.1890, -23.3310, "Zona Sur",
     "Desarrollo de Software / SaaS",
     "Alta presencia de empresas de ingeniería de software corporativo y consultorías en la nube."),
    (3, "Jardim Guanabara (Av. Higienópolis)", -51.1670, -23.3220, "Zona Centro-Sur",
     "Consultoría TI & Redes",
     "Despachos de ingeniería de sistemas, redes inalámbricas y soporte corporativo."),
    (4, "Zona Norte (Av. Saul Elkind)", -51.1480, -23.2720, "Zona Norte",
     "Asistencia de Hardware y Computadores",
     "Alta concentración de talleres locales de reparación de computadoras y servicio autorizado "
     "multimarca."),
    (5, "Zona Leste (Av. Bandeirantes)", -51.1550, -23.3180, "Zona Este",
     "Reparación de Comunicaciones",
     "Servicio técnico oficial de redes, telefonía y automatización comercial."),
]

# Hub chosen by hash digit, per business type.
HUB_ORDER = {"gastronomy": [2, 3, 5, 1, 4], "tech": [3, 2, 1, 5, 4]}
HUB_ORDER_OTHER = [1, 4, 2, 3, 5]

# City centroids, tried in this order (how, text, lng, lat).
CENTROIDS = [
    ("prefix", "cambir", -51.5778, -23.5828),
    ("prefix", "camb", -51.2782, -23.2758),
    ("prefix", "ibipor", -51.0478, -23.2694),
    ("prefix", "roland", -51.3897, -23.3105),
    ("prefix", "arapong", -51.4244, -23.4194),
    ("inside", "apucar", -51.4614, -23.5521),
    ("inside", "janda", -51.6447, -23.6064),
    ("inside", "jata", -51.6447, -23.6064),
]
CITY_SPREAD = 0.015
HUB_SPREAD = 0.0075

# Highway corridor cities in road order (name, lng, lat).
CORRIDOR_NAME = "BR-369"
CORRIDOR = [
    ("Londrina", -51.1610, -23.3110),
    ("Cambé", -51.2782, -23.2758),
    ("Rolândia", -51.3897, -23.3105),
    ("Arapongas", -51.4244, -23.4194),
    ("Apucarana", -51.4614, -23.5521),
    ("Cambira", -51.5778, -23.5828),
    ("Jandaia do Sul", -51.6447, -23.6064),
]

# Category by the first two digits of the activity code.
CATEGORIES = {
    "47": "Moda y Calzado",
    "46": "Comercio Mayorista",
    "56": "Alimentos y Bebidas",
    "55": "Alimentos y Bebidas",
    "45": "Automotriz",
    "62": "Tecnología",
    "63": "Tecnología",
    "26": "Electrónica",
    "27": "Electrónica",
    "86": "Salud",
    "87": "Salud",
    "96": "Servicios",
    "95": "Servicios",
    "64": "Servicios Financieros",
    "65": "Servicios Financieros",
    "66": "Servicios Financieros",
    "70": "Consultoría",
    "71": "Consultoría",
    "41": "Construcción",
    "42": "Construcción",
    "43": "Construcción",
    "85": "Educación",
    "84": "Administración Pública",
    "49": "Transporte",
    "50": "Transporte",
    "51": "Transporte",
    "52": "Logística",
}
CATEGORY_OTHER = "Otros"

# Technology subcategory by the first two digits (label, icon).
SUBCATEGORIES = {
    "62": ("Software & TI", "💻"),
    "63": ("Data & Servicios Web", "🌐"),
    "26": ("Electrónica", "🖥️"),
    "27": ("Electrodomésticos", "⚡"),
    "61": ("Telecomunicaciones", "📡"),
    "95": ("Reparación TI", "🔧"),
    "46": ("Comercio Mayorista TI", "📦"),
    "47": ("Retail de Tecnología", "🏪"),
    "70": ("Consultoría TI", "🤝"),
    "71": ("Ingeniería & P&D", "🔬"),
    "72": ("Investigación", "🔭"),
    "85": ("Educación TI", "🎓"),
}
SUBCATEGORY_OTHER = ("Tecnología", "💡")

# Company size descriptions.
SIZES = {
    "01": "ME (Microempresa)",
    "03": "EPP (Empresa de Pequeno Porte)",
    "05": "Grande/Otros (Demais)",
}
SIZE_OTHER = "Otros"
STREET_SIZES = ["01", "03"]

# Default texts.
NO_NAME = "Sin nombre fantasía"
NO_STREET_NAME = "Calle sin nombre"
DEFAULT_NAME = "Comercio"
DEFAULT_DISTRICT = "Centro"
DEFAULT_CITY = "Londrina"
UNKNOWN_CITY = "Unknown"
TECH_NAME = "Empresa Tech "

# House numbers that mean "none", and the address tail.
NO_NUMBER = ["0", "S/N", "SN", "s/n"]
ADDRESS_TAIL = ["PR", "Brazil"]

# Density sentences of the map.
DENSITY_NONE = "Sin comercios activos detectados en esta zona."
DENSITY_ALL = "Zona comercial consolidada con %d locales."
DENSITY_SECTOR = {
    "software": ("Desarrollo de Software", "empresas de desarrollo de software activas"),
    "support": ("Soporte TI", "empresas de soporte TI activas"),
    "repairs": ("Hardware", "talleres de reparación de hardware activos"),
}
DENSITY_SECTOR_OTHER = ("Servicios Tecnológicos", "locales tecnológicos activos")

# Operator defaults.
CLUSTER_EPS = 0.003
CLUSTER_MIN_POINTS = 1
CLUSTER_ID_BASE = 100
KDE_RESOLUTION = 100.0
KDE_BANDWIDTHS = [200.0, 500.0, 1000.0]
KDE_MARGIN = 1500.0
EARTH_RADIUS = 6378137.0

# Activity codes counted by the data profile, and its target cities.
PROFILE_CODES = {
    "retail": [
        "4711301", "4712100", "4721101", "4722901", "4751201", "4761001", "4771701", "4781400",
    ],
    "gastronomy": ["5611201", "5612100", "5620101"],
    "tech": ["6201501", "6202300", "6203100", "6204000", "6209100", "6311900", "6319400"],
    "repairs": ["9511800", "9512600", "9521500", "9529104", "9529199"],
}
PROFILE_CITIES = [4113700, 4103701, 4109807, 4101408, 4112108]
