x747