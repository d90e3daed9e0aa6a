x925