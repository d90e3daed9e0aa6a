x882