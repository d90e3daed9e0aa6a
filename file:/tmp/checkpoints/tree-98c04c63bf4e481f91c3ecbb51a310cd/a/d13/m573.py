x573