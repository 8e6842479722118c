from talkgrid.llm.functions.pii import _number_starts


def test_a_label_before_a_colon_makes_no_time():
    starts = lambda text: [text[i : i + 2] for i in _number_starts(text)]
    assert starts("Tel:06 12 34 56 78") == ["06", "12", "34", "56", "78"]
    assert starts("Steuer-ID:12 345 678 903") == ["12", "34", "67", "90"]
    assert starts("at 00:00:04.125, 10:45 or 10:45:07, 12") == ["12"]
