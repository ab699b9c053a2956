"""Books and their pages."""


def new_page(width):
    return [None] * width


# A book begins with two pages,
# both of them blank.
def open_book():
    return new_page(8) + new_page(4)
