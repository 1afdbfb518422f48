"""Facts as small tables: states, local governments, banks, operators, Pidgin particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STATES = """
North Central|Benue=Makurdi|FCT=Abuja|Kogi=Lokoja|Kwara=Ilorin|Nasarawa=Lafia|Niger=Minna|Plateau=Jos
North East|Adamawa=Yola|Bauchi=Bauchi|Borno=Maiduguri|Gombe=Gombe|Taraba=Jalingo|Yobe=Damaturu
North West|Jigawa=Dutse|Kaduna=Kaduna|Kano=Kano|Katsina=Katsina|Kebbi=Birnin Kebbi|Sokoto=Sokoto|Zamfara=Gusau
South East|Abia=Umuahia|Anambra=Awka|Ebonyi=Abakaliki|Enugu=Enugu|Imo=Owerri
South South|Akwa Ibom=Uyo|Bayelsa=Yenagoa|Cross River=Calabar|Delta=Asaba|Edo=Benin City|Rivers=Port Harcourt
South West|Ekiti=Ado Ekiti|Lagos=Ikeja|Ogun=Abeokuta|Ondo=Akure|Osun=Osogbo|Oyo=Ibadan
"""
#: N10. State: capital.
STATES = dict(sorted(pair.split("=") for line in _STATES.split("\n") for pair in line.split("|")[1:]))
STATE_NAMES = list(STATES)

_LGAS = """
Anambra=Aguata|Awka North|Awka South|Idemili North|Idemili South|Nnewi North|Nnewi South|Ogidi|Onitsha North|Onitsha South
FCT=Abaji|Abuja Municipal|Bwari|Gwagwalada|Kuje|Kwali
Kaduna=Chikun|Igabi|Kaduna North|Kaduna South|Sabon Gari|Zaria
Kano=Dala|Dawakin Tofa|Fagge|Gezawa|Gwale|Kano Municipal|Kumbotso|Nassarawa|Tarauni|Ungogo|Warawa
Lagos=Agege|Ajeromi-Ifelodun|Alimosho|Amuwo-Odofin|Apapa|Badagry|Epe|Eti-Osa|Ibeju-Lekki|Ifako-Ijaiye|Ikeja|Ikorodu|Kosofe|Lagos Island|Lagos Mainland|Mushin|Ojo|Oshodi-Isolo|Shomolu|Surulere
Oyo=Akinyele|Egbeda|Ibadan North|Ibadan North-East|Ibadan North-West|Ibadan South-East|Ibadan South-West|Ido|Oluyole|Ona Ara
Rivers=Abua/Odual|Akuku-Toru|Asari-Toru|Bonny|Degema|Eleme|Obio-Akpor|Okrika|Oyigbo|Port Harcourt
"""
#: N11. State: some of its local governments.
LGAS = {line.split("=")[0]: line.split("=")[1].split("|") for line in _LGAS.strip().split("\n")}

_BANKS = "011 First Bank;023 Citibank;030 Heritage Bank;032 Union Bank;033 United Bank for Africa;035 Wema Bank;044 Access Bank;050 Ecobank;057 Zenith Bank;058 Guaranty Trust Bank;068 Standard Chartered;070 Fidelity Bank;076 Polaris Bank;082 Keystone Bank;090110 VFD Microfinance Bank;090267 Kuda Bank;100 SunTrust Bank;100004 OPay;100022 Moniepoint;100026 Carbon;100033 PalmPay;100269 Sparkle;101 Providus Bank;102 Titan Trust Bank;103 Globus Bank;214 First City Monument Bank;215 Unity Bank;221 Stanbic IBTC;232 Sterling Bank"
#: N12. Bank: code.
BANKS = dict(sorted((b.split(" ", 1)[1], b.split(" ", 1)[0]) for b in _BANKS.split(";")))
BANK_NAMES = list(BANKS)

_TELCOS = {"9mobile": "809 817 818 908 909", "Airtel": "701 708 802 808 812 901 902 907 912", "Glo": "705 805 807 811 815 905 915", "MTN": "703 706 803 806 810 813 814 816 903 906 913 916"}
#: N13. Prefix: operator.
TELCO_PREFIXES = {f"0{p}": name for name, numbers in _TELCOS.items() for p in numbers.split()}
TELCO_NAMES = sorted(_TELCOS)

#: N14. Particles that cleaning should keep, and longer expressions.
PIDGIN = tuple("abeg abi am baba biko bros chei chop dem dey die don ehen ehn fit gidigba gist go howfar im japa jare jor kai kolo madam mama mumu na no oga oya palava pikin proper quick sabi scatter sef sha sharp shebi shey sista una vex wahala walahi wallahi wan weda well wetin wey yawa".split())
PIDGIN_EXPRESSIONS = tuple(sorted("dem no,e go be,e no,for where,how far,i no,make we,na so,na wa,no be,no dey,no vex,no wahala,wey dey,you no".split(",")))


def get_pidgin_particles() -> set[str]:
    """G3."""
    return set(PIDGIN)


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATES.items()), "state string, capital string")


def lgas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, x) for s, xs in LGAS.items() for x in xs], "state string, lga string")


def banks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANKS.items()), "bank string, code string")


def telcos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TELCO_PREFIXES.items()), "prefix string, telco string")


def pidgin(spark: SparkSession) -> DataFrame:
    rows = [(w, "particle") for w in PIDGIN] + [(w, "expression") for w in PIDGIN_EXPRESSIONS]
    return spark.createDataFrame(rows, "item string, kind string")
