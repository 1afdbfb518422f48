"""Short sentences to start models with, written for this library, and words that the Igbo seed repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SENTENCES = {
    "yor": "Mo fẹ́ ra ẹja ní ọjà.|Ọmọ náà ń ka ìwé rẹ̀.|Bàbá mi lọ sí oko ní òwúrọ̀.|Ẹ jọ̀ọ́, ẹ fún mi ní omi.|Òjò ń rọ̀ ní ìlú wa.|A máa jẹun ní alẹ́.|Olùkọ́ wa dára púpọ̀.|Ìyá mi ń se ọbẹ̀.|Ilé wọn wà lẹ́bàá odò.|Mo ti rí ọ̀rẹ́ mi lónìí.|Iṣẹ́ ni oògùn ìṣẹ́.|Ẹ káàárọ̀, ṣé dáadáa ni?|Ọjọ́ náà gùn gan-an.|Àwọn ọmọdé ń ṣeré níta.|Ó ra aṣọ tuntun fún ọmọ rẹ̀.",
    "hau": "Ina zuwa kasuwa yanzu.|Yaro yana karanta littafi.|Ruwa ya yi yawa a bana.|Mun ci abinci da yamma.|Uwata tana dafa miya.|Ɗan uwana ya tafi gona.|Ƙofar gida a buɗe take.|Malami ya shiga aji.|Sannu da aiki, ya gajiya?|Ɓarawo ya gudu cikin dare.|Gobe za mu tafi Kano.|Yara suna wasa a waje.|Ki kawo mini ruwan sha.|Kasuwar ta cika da mutane.|Wannan mota sabuwa ce.",
    "ibo": "Achọrọ m ịzụ azụ n'ahịa.|Nwa ahụ na-agụ akwụkwọ.|Nna m gara ugbo n'ụtụtụ.|Biko nye m mmiri ọṅụṅụ.|Mmiri na-ezo n'obodo anyị.|Anyị ga-eri nri n'abalị.|Onye nkụzi anyị dị mma.|Nne m na-esi ofe.|Ụlọ ha dị n'akụkụ osimiri.|Ahụrụ m enyi m taa.|Ọrụ ike na-eweta ụba.|Ụmụaka na-egwuri egwu n'èzí.|Ọ zụtara akwa ọhụrụ.|Kedụ ka ị mere?|Ndị ọbịa abịala n'ụlọ.",
    "pcm": "I wan go market go buy fish.|Dem don chop finish since morning.|Abeg give me small water make I drink.|Rain dey fall for our side.|Which kain wahala be dis?|My mama dey cook soup for kitchen.|Di pikin no gree go school today.|We go see tomorrow, no vex.|Na so di matter take happen.|E don tey wey I see am.|Wetin you dey find for here?|Oga say make we wait small.|Dis moto na new one.|How far, you don reach house?|Light no dey since yesterday.",
    "eng": "I want to buy some fish at the market.|The child is reading her book.|My father went to the farm early.|Please give me a glass of water.|It is raining in our town today.|We shall eat dinner at seven.|Our teacher explains things very well.|My mother is cooking soup.|Their house stands near the river.|I met my friend this afternoon.|Hard work brings its own reward.|The children are playing outside.|She bought new clothes for her son.|How are you feeling this morning?|The visitors arrived before noon.",
}
#: Igbo words that ordinary texts have so often that a seed should too: word, weight.
_IBO_WORDS = {"ọma": 50, "ụlọ": 50, "ọrụ": 50, "ụtụtụ": 50, "akwụkwọ": 50, "dị": 200, "nwụọ": 20, "ọzọ": 50, "ịhụ": 50, "ị": 200}


def seed_texts(spark: SparkSession) -> DataFrame:
    """(ord, lang, text, weight). weight stands for repetition."""
    rows = [(lang, t, 1) for lang, x in _SENTENCES.items() for t in x.split("|")] + [("ibo", w, n) for w, n in _IBO_WORDS.items()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, lang string, text string, weight int")
