x569