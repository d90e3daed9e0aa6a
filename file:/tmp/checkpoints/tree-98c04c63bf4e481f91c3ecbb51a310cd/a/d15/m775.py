x775