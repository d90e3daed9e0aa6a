x690