x124