"""Keeping accounts."""

from storage import open_book


class Account:
    def label(self):
        return "plain"


# to whole cents
def round_cents(amount):
    return int(amount * 100) / 100


class Savings(Account):
    rate = 2

    def deposit(self, amount):
        book = open_book()
        book.append(round_cents(amount))
        return book
