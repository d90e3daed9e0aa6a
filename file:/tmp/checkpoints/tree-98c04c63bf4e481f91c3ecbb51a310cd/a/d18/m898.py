x898