x710