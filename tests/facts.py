"""A small document of facts: 30 units, a pin mapping and a table."""

from veritab.schemas import BIJECTIONS, GRIDS, UNITS

# Id, label, value, unit, context, x, y, page
FACTS = [
    ("u_vcc", "VCC", 3.3, "V", "supply voltage", 0.1, 0.1, 0), ("u_vmax", "VCC max", 5.5, "V", "absolute maximum voltage", 0.2, 0.1, 0),
    ("u_imax", "ICC max", 250.0, "mA", "maximum supply current", 0.3, 0.1, 0), ("u_pd", "PD", 500.0, "mW", "power dissipation", 0.4, 0.1, 0),
    ("u_esd_hbm", "ESD HBM", 2000.0, "V", "ESD Human Body Model", 0.5, 0.1, 0), ("u_esd_cdm", "ESD CDM", 500.0, "V", "ESD Charged Device Model", 0.5, 0.15, 0),
    ("u_ileak", "IIL", 1.0, "µA", "input leakage current", 0.6, 0.1, 0), ("u_vth_l", "VIL", 0.8, "V", "input low threshold voltage", 0.7, 0.1, 0),
    ("u_vth_h", "VIH", 2.0, "V", "input high threshold voltage", 0.7, 0.15, 0), ("u_fmax", "FCLK", 100.0, "MHz", "maximum clock frequency", 0.1, 0.2, 1),
    ("u_tpd", "tPD", 5.5, "ns", "propagation delay", 0.2, 0.2, 1), ("u_tr", "tR", 2.0, "ns", "rise time", 0.3, 0.2, 1),
    ("u_tf", "tF", 2.5, "ns", "fall time", 0.3, 0.25, 1), ("u_tsu", "tSU", 3.0, "ns", "setup time", 0.4, 0.2, 1),
    ("u_th", "tH", 1.0, "ns", "hold time", 0.4, 0.25, 1), ("u_pkg", "Package", "TQFP-48", None, "package type", 0.1, 0.3, 2),
    ("u_dim_l", "Length", 7.0, "mm", "package dimension length", 0.2, 0.3, 2), ("u_dim_w", "Width", 7.0, "mm", "package dimension width", 0.3, 0.3, 2),
    ("u_theta_ja", "θJA", 45.0, "°C/W", "thermal resistance junction to ambient", 0.4, 0.3, 2), ("u_weight", "Weight", 0.5, "g", "component weight", 0.5, 0.3, 2),
    ("u_msl", "MSL", "3", None, "moisture sensitivity level", 0.6, 0.3, 2), ("u_top_min", "TOPR min", -40.0, "°C", "operating temperature minimum", 0.1, 0.4, 0),
    ("u_top_max", "TOPR max", 85.0, "°C", "operating temperature maximum", 0.2, 0.4, 0), ("u_tsto_min", "TSTO min", -65.0, "°C", "storage temperature minimum", 0.3, 0.4, 0),
    ("u_tsto_max", "TSTO max", 150.0, "°C", "storage temperature maximum", 0.4, 0.4, 0), ("u_tsolder", "Tsolder", 260.0, "°C", "reflow soldering temperature", 0.5, 0.4, 0),
    ("u_absmax_i", "Absolute max current", 500.0, "mA", "absolute maximum current", 0.6, 0.4, 0), ("u_partno", "Part Number", "XQ-48Q", None, "part number ordering information", 0.1, 0.5, 0),
    ("u_desc", "Description", "High-speed 48-pin quad flat package logic IC", None, "general description overview", 0.2, 0.5, 0), ("u_vcc_min", "VCC min", 2.7, "V", "minimum supply voltage", 0.1, 0.05, 0),
]
PINS = [("1", "VCC"), ("2", "GND"), ("3", "CLK"), ("4", "DATA"), ("5", "RST"), ("6", "CS")]
TABLE = [["Parameter", "Min", "Typ", "Max"], ["Supply Voltage", "2.7", "3.3", "5.5"], ["Operating Temperature", "-40", "25", "85"], ["Recommended Operating Conditions", "See table", "", ""]]

ANSWERS = {
    "What is pin 5?": "RST", "What is the maximum voltage?": "5.5 V", "What is the maximum current?": "500.0 mA", "What is the absolute maximum voltage?": "5.5 V",
    "What is the absolute maximum current?": "500.0 mA", "What is the supply voltage range?": "2.7 to 5.5 V", "What is the operating temperature range?": "-40.0 to 85.0 °C",
    "What is the storage temperature range?": "-65.0 °C", "What is the reflow soldering temperature?": "260.0 °C", "What is the max power dissipation?": "500.0 mW",
    "What are the ESD ratings?": "ESD HBM: 2000.0 V; ESD CDM: 500.0 V", "What is the input leakage current?": "1.0 µA",
    "What are the logic threshold levels?": "VCC: 3.3 V; VCC max: 5.5 V; VIL: 0.8 V; VIH: 2.0 V", "What is the max clock frequency?": "100.0 MHz", "What is the propagation delay?": "5.5 ns",
    "What are the rise and fall times?": "tR: 2.0 ns; tF: 2.5 ns", "What are the setup and hold times?": "tSU: 3.0 ns; tH: 1.0 ns", "What package is this?": "TQFP-48",
    "What are the package dimensions?": "TQFP-48", "What is the thermal resistance?": "45.0 °C/W", "What is the component weight?": "0.5 g", "How many pins does it have?": "6",
    "What is the MSL rating?": "3", "What is the part number?": "XQ-48Q", "What does this component do?": "High-speed 48-pin quad flat package logic IC",
    "What is the gravitational constant of this chip?": "1.0 ns",
}


def unit(i, f, doc="d1", bbox=None, agreement=0.5):
    uid, label, value, uom, context, x, y, page = f
    text = value if isinstance(value, str) else None
    return (uid, label, text, None if text is not None else float(value), uom, context, agreement, (x, y), bbox, doc, page, "org", i)


def units(spark, facts=FACTS, **kw):
    return spark.createDataFrame([unit(i, f, **kw) for i, f in enumerate(facts)], UNITS)


def bijections(spark, pins=PINS):
    return spark.createDataFrame([("pinout", [k for k, _ in pins], [v for _, v in pins], pins, (0.5, 0.3), None, "d1", 0, "org", 0)] if pins else [], BIJECTIONS)


def grids(spark, table=TABLE):
    cells = [(r, c, v, (0.1 + 0.2 * c, 0.5 + 0.05 * r)) for r, row in enumerate(table) for c, v in enumerate(row)]
    return spark.createDataFrame([("rec_op", len(table), 4, cells, (0.1, 0.5), None, "d1", 0, "org", 0)] if table else [], GRIDS)
