x579