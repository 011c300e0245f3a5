"""The dictionary and the messages, value by value."""

from pyspark.sql import functions as F

from tactile.functions import braille
from tactile.operators.capture import FORCED, UTTERANCES

# The pattern of every character.
PATTERNS = {
    "ก": "⠛", "ข": "⠅", "ฃ": "⠅", "ค": "⠥", "ฅ": "⠥", "ฆ": "⠯", "ง": "⠽", "จ": "⠉", "ฉ": "⠩", "ช": "⠙", "ซ": "⠵", "ฌ": "⠟", "ญ": "⠫",
    "ฎ": "⠿", "ฏ": "⠾", "ฐ": "⠳", "ฑ": "⠻", "ฒ": "⠭", "ณ": "⠝", "ด": "⠙", "ต": "⠞", "ถ": "⠏", "ท": "⠾", "ธ": "⠮", "น": "⠝", "บ": "⠃",
    "ป": "⠏", "ผ": "⠧", "ฝ": "⠋", "พ": "⠗", "ฟ": "⠛", "ภ": "⠟", "ม": "⠍", "ย": "⠽", "ร": "⠗", "ล": "⠇", "ว": "⠺", "ศ": "⠯", "ษ": "⠷",
    "ส": "⠎", "ห": "⠓", "ฬ": "⠟", "อ": "⠕", "ฮ": "⠿", "ะ": "⠁", "า": "⠜", "ิ": "⠊", "ี": "⠔", "ึ": "⠪", "ื": "⠫", "ุ": "⠥", "ู": "⠳",
    "เ": "⠑", "แ": "⠣", "โ": "⠕", "ใ": "⠭", "ไ": "⠏", "ำ": "⠦", "็": "⠒", "่": "⠔", "้": "⠲", "๊": "⠶", "๋": "⠦", "์": "⠴", "a": "⠁",
    "b": "⠃", "c": "⠉", "d": "⠙", "e": "⠑", "f": "⠋", "g": "⠛", "h": "⠓", "i": "⠊", "j": "⠚", "k": "⠅", "l": "⠇", "m": "⠍", "n": "⠝",
    "o": "⠕", "p": "⠏", "q": "⠟", "r": "⠗", "s": "⠎", "t": "⠞", "u": "⠥", "v": "⠧", "w": "⠺", "x": "⠭", "y": "⠽", "z": "⠵", "1": "⠁",
    "2": "⠃", "3": "⠉", "4": "⠙", "5": "⠑", "6": "⠋", "7": "⠛", "8": "⠓", "9": "⠊", "0": "⠚", "#": "⠼", "A": "⠁", "B": "⠃", "C": "⠉",
    "D": "⠙", "E": "⠑", "F": "⠋", "G": "⠛", "H": "⠓", "I": "⠊", "J": "⠚", "K": "⠅", "L": "⠇", "M": "⠍", "N": "⠝", "O": "⠕", "P": "⠏",
    "Q": "⠟", "R": "⠗", "S": "⠎", "T": "⠞", "U": "⠥", "V": "⠧", "W": "⠺", "X": "⠭", "Y": "⠽", "Z": "⠵",
}
# What is said for each code.
MESSAGES = {
    "NO_DOC": "ยังไม่พบเอกสาร กรุณาส่องกล้องไปที่หนังสือ",
    "BLURRY": "ภาพยังเบลออยู่ ถือกล้องนิ่งๆ อีกนิดนะครับ",
    "HOLD_START": "ตัวอักษรชัดเจนแล้ว ถือค้างไว้นะครับ...",
    "WARN": "กำลังถ่ายภาพ อยู่นิ่งๆ นะครับ",
    "FIRE": "ถ่ายภาพสำเร็จ กำลังอ่านข้อความภาษาอังกฤษ...",
    "ALL_OUT": "ยังไม่เข้ามุม กรุณาขยับหนังสือให้ตรงกรอบ 4 มุม",
    "TOP": "มุมด้านบนหลุดกรอบ ให้เลื่อนกล้องขึ้นบน",
    "BOTTOM": "มุมด้านล่างหลุดกรอบ ให้เลื่อนกล้องลงล่าง",
    "LEFT": "มุมด้านซ้ายหลุดกรอบ ให้ขยับกล้องไปทางซ้าย",
    "RIGHT": "มุมด้านขวาหลุดกรอบ ให้ขยับกล้องไปทางขวา",
    "TL": "มุมบนซ้ายหลุดกรอบ",
    "TR": "มุมบนขวาหลุดกรอบ",
    "BL": "มุมล่างซ้ายหลุดกรอบ",
    "BR": "มุมล่างขวาหลุดกรอบ",
}


def test_every_pattern(spark):
    assert len(PATTERNS) == 127 and set(braille.DOTS) == set(PATTERNS)
    text = "".join(PATTERNS)
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(braille.encode(F.col("text"))).first()[0] == "".join(PATTERNS.values())


def test_every_message():
    assert UTTERANCES == MESSAGES and len(MESSAGES) == 14 and FORCED == ("WARN", "FIRE")
